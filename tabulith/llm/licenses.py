"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, a sentence is normalised (lower case, everything but letters and digits
one blank), and known sentences get identifiers by patterns on the normalised form, so that names,
years and versions may vary. Sentences of licence texts are known by how they begin; others by what they
say of a licence ("... under the terms of ...", its title, its full name), wherever in them it stands. One
that puts a thing under several licences is cut before each; what it says isn't so ("not licensed under") counts for none. Lines are joined: a sentence ends at a closing mark that a blank follows
or at a line without letters and digits, and a line break, a colon or a semicolon ends it only where
a known opening follows. An SPDX tag is a sentence of its own up to the end of its line, one for each
licence of its expression. A document's identifiers in order are then matched against ordered
licence rules, sequences of identifiers that must occur one after the other with nothing known in
between; a rule that matches uses its identifiers up, and later rules see what is left. Rules for
longer texts come before rules for their parts.

Only documents that hold one of the cue words, at least one of which every known sentence has, are cut
into sentences at all; no shuffle is made. Defined cases: null and empty texts have no sentences;
equal licences of a document are listed once, in order of their rules; columns of the input are kept
and those that carry an output's name replaced; rows are independent, so repeated rows are equal.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, replaced, table

# Openings and whole sentences of public licences, normalised, as patterns that must
# match from the start of a sentence. The first that matches names the sentence.
SENTENCES = (
    ("spdx", r"(?:spdx )?spdx license identifier "),
    ("apache2_header", r"(?:this (?:work|file|code|software|project) is )?licensed under the apache license,? version 2"),
    ("apache2_obtain", r"you may obtain a copy of the license at "),
    ("apache2_asis", r"unless required by applicable law or agreed to in writing software "),
    ("apache2_limits", r"see the license for the specific language governing permissions and "),
    ("agpl_header", r"(?:this (?:work|program|file|code|software|project) is )?(?:free software )?licensed under the gnu affero general public license"),
    ("lgpl_header", r"(?:this (?:work|program|file|code|software|project) is )?licensed under the gnu (?:lesser|library) general public license"),
    ("gpl3_header", r"(?:this (?:work|program|file|code|software|project) is )?licensed under the gnu general public license (?:v|version )?3"),
    ("gpl2_header", r"(?:this (?:work|program|file|code|software|project) is )?licensed under the gnu general public license (?:v|version )?2"),
    ("gpl_header", r"(?:this (?:work|program|file|code|software|project) is )?licensed under the gnu general public license"),
    ("agpl_free", r"(?:this program|this file|this software|it) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("lgpl_free", r"(?:this library|this program|this file|this software|it) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("gpl_free", r"(?:this program|this file|this software|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl_hope", r"this (?:program|library|file|software) is distributed in the hope that it will be useful but without any warranty"),
    ("mit_header", r"(?:this (?:work|file|code|software|project) is )?(?:released|licensed|distributed) under the mit license"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in "),
    ("mit_asis", r"the software is provided as is without warranty of any kind"),
    ("postgresql_grant", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("isc_grant", r"permission to use copy modify and (?:or )?distribute this software for any purpose "),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", r"neither the name of .* may be used to endorse or promote products"),
    ("bsd_asis", r"this software is provided by .* as is and any express or implied warranties"),
    ("bsd_header", r"(?:this (?:work|file|code|software|project) is )?(?:released|licensed|distributed) under the (?:(?:2|3) clause )?bsd (?:(?:2|3) clause )?license"),
    ("mpl_header", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl_copy", r"if a copy of the mpl was not distributed with this file you can obtain one at "),
    ("cc_by_nc_nd", r"(?:this (?:work|text|page) is )?licensed under (?:a |the )?(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv)"),
    ("cc_by_nc_sa", r"(?:this (?:work|text|page) is )?licensed under (?:a |the )?(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)"),
    ("cc_by_nc", r"(?:this (?:work|text|page) is )?licensed under (?:a |the )?(?:cc by nc|creative commons attribution non ?commercial)"),
    ("cc_by_nd", r"(?:this (?:work|text|page) is )?licensed under (?:a |the )?(?:cc by nd|creative commons attribution no ?deriv)"),
    ("cc_by_sa", r"(?:this (?:work|text|page) is )?licensed under (?:a |the )?(?:cc by sa|creative commons attribution share ?alike)"),
    ("cc_by", r"(?:this (?:work|text|page) is )?licensed under (?:a |the )?(?:cc by|creative commons attribution)"),
    ("cc0", r"(?:this (?:work|text|page) is )?(?:licensed under (?:a |the )?cc0|dedicated to the public domain)"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("reserved", r"(?:copyright .* )?all rights reserved"),
    ("zlib_asis", r"this software is provided as is without any express or implied warranty"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose"),
    ("boost_grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("see_license", r"see (?:the )?(?:file )?(?:license|copying)(?: md| txt| file)? for "),
    ("other_license", r"(?:this (?:work|file|code|software|project) is )?(?:released|licensed|distributed) under (?:the |a |an )?(?:[a-z0-9]+ ){1,5}licen[sc]e"),
)
# Names of public licences, normalised, as patterns. Short ones count after "under" and the like
# only; full ones wherever they stand. Narrower names come first.
NAMES = (
    ("apache2", r"apache (?:software )?(?:licen[sc]e )?(?:version |v )?2", r"apache (?:software )?licen[sc]e (?:version |v )?2"),
    ("agpl", r"agpl|affero general public licen[sc]e", r"affero general public licen[sc]e"),
    ("lgpl", r"lgpl|(?:lesser|library) general public licen[sc]e", r"gnu (?:lesser|library) general public licen[sc]e"),
    ("gpl3", r"(?:gpl|general public licen[sc]e) ?(?:version |v ?)?3", r"gnu general public licen[sc]e (?:version |v ?)3"),
    ("gpl2", r"(?:gpl|general public licen[sc]e) ?(?:version |v ?)?2", r"gnu general public licen[sc]e (?:version |v ?)2"),
    ("gpl", r"gpl|general public licen[sc]e", r"gnu general public licen[sc]e"),
    ("mit", r"(?:mit|expat)(?![a-z0-9])", None),
    ("bsd", r"(?:(?:new|modified|simplified|revised|[234] clause) )*bsd", None),
    ("isc", r"isc(?![a-z0-9])", None),
    ("mpl10", r"(?:mpl|mozilla public licen[sc]e) ?(?:version |v ?)?1 0", r"mozilla public licen[sc]e (?:version |v ?)?1 0"),
    ("mpl11", r"(?:mpl|mozilla public licen[sc]e) ?(?:version |v ?)?1 1", r"mozilla public licen[sc]e (?:version |v ?)?1 1"),
    ("mpl", r"mpl|mozilla public licen[sc]e", r"mozilla public licen[sc]e"),
    ("epl10", r"(?:epl|eclipse public licen[sc]e) ?(?:version |v ?)?1 0", r"eclipse public licen[sc]e (?:version |v ?)?1 0"),
    ("epl", r"epl|eclipse public licen[sc]e", r"eclipse public licen[sc]e"),
    ("eupl", r"eupl|european union public licen[sc]e", r"european union public licen[sc]e"),
    ("cddl", r"cddl|common development and distribution licen[sc]e", r"common development and distribution licen[sc]e"),
    ("bsl", r"boost software licen[sc]e", r"boost software licen[sc]e"),
    ("zlib", r"zlib", None),
    ("artistic", r"artistic licen[sc]e", r"artistic licen[sc]e (?:version )?[12] 0"),
    ("cc_by_nc_nd", r"cc by nc nd|creative commons attribution non ?commercial no ?deriv", r"creative commons attribution non ?commercial no ?deriv"),
    ("cc_by_nc_sa", r"cc by nc sa|creative commons attribution non ?commercial share ?alike", r"creative commons attribution non ?commercial share ?alike"),
    ("cc_by_nc", r"cc by nc|creative commons attribution non ?commercial", r"creative commons attribution non ?commercial"),
    ("cc_by_nd", r"cc by nd|creative commons attribution no ?deriv", r"creative commons attribution no ?deriv"),
    ("cc_by_sa", r"cc by sa|creative commons attribution share ?alike", r"creative commons attribution share ?alike"),
    ("cc_by", r"cc by|creative commons attribution", r"creative commons attribution"),
    ("unlicense", r"unlicense", None),
    ("cc0", r"cc0|creative commons zero", r"(?:cc0 1 0|creative commons zero)"),
    ("ofl", r"(?:sil )?(?:ofl|open font licen[sc]e)", r"sil open font licen[sc]e"),
    ("postgresql", r"postgresql licen[sc]e", None),
    ("openssl", r"openssl licen[sc]e", None),
    ("wtfpl", r"wtfpl|do what the f[a-z]* you want to public licen[sc]e", r"do what the f[a-z]* you want to public licen[sc]e"),
    ("mspl", r"(?:ms pl|microsoft public licen[sc]e)", r"microsoft public licen[sc]e"),
    ("upl", r"(?:upl|universal permissive licen[sc]e)", r"universal permissive licen[sc]e"),
)
_VERB = r"(?:licensed|released|distributed|available|provided|covered|published|redistributed|used|licen[sc]e)"
_UNDER = rf"{_VERB} under (?:either |both )?(?:of )?(?:the |a |an )?(?:terms (?:and conditions )?(?:of )?(?:the |a |an )?)?(?:gnu )?"
#: What a sentence denies: that something is, or that this is like what is, under a licence.
DENIED = rf"(?:^| )(?:(?:not|never|no longer) (?:(?:be|been|being|yet|currently|itself|code|necessarily) )?(?:{_VERB} )?|unlike (?:[a-z0-9]+ )?(?:[a-z0-9]+ )?(?:[a-z0-9]+ )?(?:[a-z0-9]+ )?)under "
# A further licence of a sentence that says "under" is a sentence of its own.
_BUT = rf" but (?:instead |rather |is |are )?(?:{_VERB} )?under "
_OR = r" (?:or|and) (?:under )?(?:the |a |an )?(?:terms of the )?(?:gnu )?((?:" + "|".join(n.replace("(?![a-z0-9])", "") for _, n, _ in NAMES) + r")(?:v[0-9]+)?\b)"
# What is asked before the openings: the grant that ends where others state conditions.
FIRST = (("mit0_grant", r"^permission is hereby granted free of charge to any person obtaining a copy of this software .* furnished to do so$"),)
# Titles, which are sentences of their own.
_TITLES = (
    ("mit_title", r"^(?:the )?mit licen[sc]e(?: mit)?$"),
    ("mit0_title", r"^(?:the )?mit no attribution(?: licen[sc]e)?(?: mit 0)?$"),
    ("postgresql_title", r"^(?:the )?postgresql licen[sc]e$"),
    ("openssl_title", r"^(?:the )?openssl licen[sc]e$"),
    ("isc_title", r"^(?:the )?isc licen[sc]e$"),
    ("bsd3_title", r"^(?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd) licen[sc]e$"),
    ("bsd2_title", r"^(?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd) licen[sc]e$"),
    ("zlib_title", r"^(?:the )?zlib licen[sc]e$"),
    ("unlicense_title", r"^(?:the )?unlicense$"),
)
#: What a sentence may say anywhere, by identifier.
INSIDE = (*_TITLES, ("denied", DENIED), *((f"{n}_under", rf"(?:^| ){_UNDER}(?:{short})") for n, short, _ in NAMES), *((f"{n}_named", rf"(?:^| ){full}") for n, _, full in NAMES if full))
#: Each known sentence holds one of these, in any case.
CUES = ("licen", r"\bunder\b", "permission", "redistribution", "warrant", "copyright", "rights reserved", "public domain", "free software", "the name of", "software is", "mpl was", "cc by", "cc0", "creative commons", "applicable law", "copying", "no attribution")
_LICENSES = {
    "apache2": "Apache-2.0", "agpl": "AGPL", "lgpl": "LGPL", "gpl3": "GPL-3.0", "gpl2": "GPL-2.0", "gpl": "GPL", "mit": "MIT", "bsd": "BSD", "isc": "ISC", "mpl": "MPL-2.0", "epl": "EPL-2.0", "eupl": "EUPL", "cddl": "CDDL", "bsl": "BSL-1.0", "zlib": "Zlib", "artistic": "Artistic", "mpl10": "MPL-1.0", "mpl11": "MPL-1.1", "epl10": "EPL-1.0",
    "cc_by_nc_nd": "CC-BY-NC-ND", "cc_by_nc_sa": "CC-BY-NC-SA", "cc_by_nc": "CC-BY-NC", "cc_by_nd": "CC-BY-ND", "cc_by_sa": "CC-BY-SA", "cc_by": "CC-BY", "unlicense": "Unlicense", "cc0": "CC0", "ofl": "OFL", "postgresql": "PostgreSQL", "openssl": "OpenSSL", "wtfpl": "WTFPL", "mspl": "MS-PL", "upl": "UPL",
}
# Ordered rules, a licence and the identifiers it is recognised by.
RULES = (
    ("Apache-2.0", ("apache2_header", "apache2_obtain", "apache2_asis", "apache2_limits")),
    ("Apache-2.0", ("apache2_header", "apache2_obtain")),
    ("MIT-0", ("mit0_title", "mit0_grant", "mit_asis")),
    ("MIT-0", ("mit0_grant", "mit_asis")),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_asis")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_asis")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("AGPL", ("agpl_free", "gpl_hope")),
    ("LGPL", ("lgpl_free", "gpl_hope")),
    ("GPL", ("gpl_free", "gpl_hope")),
    ("MPL-2.0", ("mpl_header", "mpl_copy")),
    ("Apache-2.0", ("apache2_header",)),
    ("AGPL", ("agpl_header",)),
    ("LGPL", ("lgpl_header",)),
    ("GPL-3.0", ("gpl3_header",)),
    ("GPL-2.0", ("gpl2_header",)),
    ("GPL", ("gpl_header",)),
    ("GPL", ("gpl_free",)),
    ("MIT", ("mit_header",)),
    ("MIT", ("mit_grant",)),
    ("MIT-0", ("mit0_grant",)),
    ("PostgreSQL", ("postgresql_grant",)),
    ("ISC", ("isc_grant",)),
    ("BSD", ("bsd_header",)),
    ("BSD", ("bsd_grant",)),
    ("MPL-2.0", ("mpl_header",)),
    ("CC-BY-NC-ND", ("cc_by_nc_nd",)),
    ("CC-BY-NC-SA", ("cc_by_nc_sa",)),
    ("CC-BY-NC", ("cc_by_nc",)),
    ("CC-BY-ND", ("cc_by_nd",)),
    ("CC-BY-SA", ("cc_by_sa",)),
    ("CC-BY", ("cc_by",)),
    ("CC0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("AGPL", ("agpl_free",)),
    ("LGPL", ("lgpl_free",)),
    ("Zlib", ("zlib_asis", "zlib_grant")),
    ("Zlib", ("zlib_grant",)),
    ("BSL-1.0", ("boost_grant",)),
    ("MIT", ("mit_title",)),
    ("MIT-0", ("mit0_title",)),
    ("PostgreSQL", ("postgresql_title",)),
    ("OpenSSL", ("openssl_title",)),
    ("ISC", ("isc_title",)),
    ("BSD-3-Clause", ("bsd3_title",)),
    ("BSD-2-Clause", ("bsd2_title",)),
    ("Zlib", ("zlib_title",)),
    ("Unlicense", ("unlicense_title",)),
    *((_LICENSES[n], (f"{n}_{how}",)) for how in ("under", "named") for n, _, full in NAMES if how == "under" or full),
    ("see-file", ("see_license",)),
    ("other", ("other_license",)),
    ("all-rights-reserved", ("reserved",)),
)
_SPDX = "spdx license identifier "
# Licences of SPDX tags, by patterns of the normalised tag.
SPDX = (
    ("Apache-2.0", "apache 2 0"),
    ("MIT", "mit(?! (?:0|advertising|click|cmu|enna|feh|festival|khronos|modern|open|testregex|wu)(?![a-z0-9]))"),
    ("BSD-3-Clause", "bsd 3 clause"),
    ("BSD-2-Clause", "bsd 2 clause"),
    ("BSD", "bsd"),
    ("AGPL", "agpl"),
    ("LGPL", "lgpl"),
    ("GPL-3.0", "gpl 3(?: 0)?"),
    ("GPL-2.0", "gpl 2(?: 0)?"),
    ("GPL", "gpl"),
    ("ISC", "isc"),
    ("MPL-2.0", "mpl 2 0"),
    ("MPL-1.1", "mpl 1 1"),
    ("MPL-1.0", "mpl 1 0"),
    ("CC-BY-NC-ND", "cc by nc nd"),
    ("CC-BY-NC-SA", "cc by nc sa"),
    ("CC-BY-NC", "cc by nc"),
    ("CC-BY-ND", "cc by nd"),
    ("CC-BY-SA", "cc by sa"),
    ("CC-BY", "cc by"),
    ("CC0", "cc0"),
    ("Unlicense", "unlicense"),
    ("EPL-1.0", "epl 1 0"),
    ("EPL-2.0", "epl"),
    ("OFL", "ofl"),
    ("PostgreSQL", "postgresql"),
    ("OpenSSL", "openssl"),
    ("WTFPL", "wtfpl"),
    ("MS-PL", "ms pl"),
    ("UPL", "upl"),
    ("EUPL", "eupl"),
    ("CDDL", "cddl"),
    ("BSL-1.0", "bsl 1 0"),
    ("Zlib", "zlib"),
    ("Artistic", "artistic"),
)


def _open_end(pattern: str) -> str:
    """A pattern of ``SENTENCES`` whose last blank may as well be the sentence's end."""
    p = pattern.replace(",?", "")
    return f"{p[:-1]}(?![a-z0-9])" if p.endswith(" ") else p


_OPENINGS = tuple((name, _open_end(p)) for name, p in SENTENCES)
#: What sentences are matched against: tags of known licences, then SENTENCES, "spdx" being any other tag.
_KNOWN = (*((f"spdx_{name.lower()}", f"^{_SPDX}{p}(?![a-z0-9])") for name, p in SPDX), *FIRST, *((n, f"^{p}") for n, p in _OPENINGS[:-1]), *INSIDE, *((n, f"^{p}") for n, p in _OPENINGS[-1:]))
_ORDERED = (*((name, (f"spdx_{name.lower()}",)) for name, _ in SPDX), *RULES, ("other", ("spdx",)))
# Marks in lowered text, which has no other capitals: C cuts, W (a wrapped line, ':' or ';') may cut.
_TAG = r"((?:spdx[^a-z0-9\n]+)?spdx[^a-z0-9\n]+license[^a-z0-9\n]+identifier[^a-z0-9\n][^\n]*)"
_LEADER = r"(^|\n)[^a-z0-9\n]*(?:dnl|rem)(?![a-z0-9])"
_CUT = r"[.!?][\x20\x09-\x0D]|\n[^a-z0-9\n]*\n"
_WRAP = r"\n|[:;][\x20\x09\x0B-\x0D]"
_WIDE = {"[a-z0-9 ]*": "[a-z0-9 W]*", ".*": "[^C]*", " ?": "[ W]*", " ": "[ W]+"}
_SPLIT = "C|W(?=[ W]*(?:" + "|".join(re.sub(r"\[a-z0-9 \]\*|\.\*| \?| ", lambda m: _WIDE[m[0]], p) for _, p in _OPENINGS) + "))"


def _each_license(sentence: Column) -> Column:
    """A sentence cut before each further licence that it puts something under, unless it denies that."""
    cut = lambda s: F.when(s.rlike(_UNDER) & ~s.rlike(DENIED), F.regexp_replace(s, _OR, "Clicensed under $1")).otherwise(s)
    parts = F.flatten(F.transform(F.split(F.regexp_replace(sentence, _BUT, "Clicensed under "), "C"), lambda s: F.split(cut(s), "C")))
    return F.when(sentence.contains("under ") & sentence.rlike(" (?:or|and|but) "), parts).otherwise(F.array(sentence))


def sentences(text: Column) -> Column:
    """The normalised sentences of a text that aren't blank, in order."""
    marked = F.regexp_replace(F.regexp_replace(lower_ascii(text), _LEADER, "$1"), _TAG, "C$1C")
    marked = F.regexp_replace(F.regexp_replace(marked, _CUT, "C"), _WRAP, "W")
    parts = F.split(F.regexp_replace(marked, "[^a-z0-9CW]+", " "), _SPLIT)
    plain = lambda s: F.btrim(F.regexp_replace(s, "[ W]+", " "))
    known = F.transform(parts, plain)
    each = lambda s: F.transform(F.split(F.regexp_replace(s, f"^(?:spdx )?{_SPDX}", ""), " (?:or|and) (?!later)"), lambda x: F.concat(F.lit(_SPDX), x))
    tags = F.flatten(F.transform(known, lambda s: F.when(s.rlike(f"^(?:spdx )?{_SPDX}"), each(s)).otherwise(F.array(s))))
    told = F.filter(F.when(F.exists(known, lambda s: s.contains("spdx")), tags).otherwise(known), lambda s: s != "")
    return F.flatten(F.transform(told, _each_license))


def identifier(sentence: Column) -> Column:
    """The identifier of a known sentence, null for others. The sentence itself is normalised."""
    out = None
    for name, pattern in _KNOWN:
        hit = sentence.rlike(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    any_word = sentence.rlike("|".join(re.sub(" ", "[ ]", c) for c in CUES) + "|spdx")
    return F.when(any_word, out)


def match_rules(ids: Column) -> Column:
    """struct(licenses, rest): the licences of an identifier sequence, and what no rule used up.

    The sequence is a text ";a;b;" so that a rule is a piece of it; a matched piece becomes ";|;", which
    keeps apart what stood on its two sides.
    """
    state = F.struct(F.concat(F.lit(";"), F.array_join(ids, ";;"), F.lit(";")).alias("left"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("".join(f";{k};" for k in seq)).alias("piece")) for n, seq in _ORDERED])

    def use(s: Column, r: Column) -> Column:
        hit = F.contains(s["left"], r["piece"])
        return F.when(hit, F.struct(F.replace(s["left"], r["piece"], F.lit(";|;")).alias("left"), F.array_append(s["found"], r["name"]).alias("found"))).otherwise(s)

    end = lambda s: F.struct(F.array_distinct(s["found"]).alias("licenses"), F.filter(F.split(s["left"], ";+"), lambda x: ~x.isin("", "|")).alias("rest"))
    return F.aggregate(rules, state, use, end)


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with sentence_ids, licenses, license (the first or null) and rest_ids."""
    text = docs[text_col]
    # on the raw text a cue's words may have anything but letters and digits between them
    cued = F.lower(text).rlike("|".join(c.replace(" ", "[^a-z0-9]+") for c in CUES) + "|spdx")
    ids = F.filter(F.transform(F.when(cued, sentences(text)), identifier), lambda x: x.isNotNull())
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    empty = F.struct(F.array().cast("array<string>").alias("licenses"), F.array().cast("array<string>").alias("rest"))
    matched = packed.withColumn("m", F.when(F.size("ids") > 0, match_rules(F.col("ids"))).otherwise(empty))
    flat = matched.select("row.*", F.col("ids").alias("__ids"), F.col("m").alias("__m"))
    out = replaced(flat, sentence_ids=F.col("__ids"), licenses=F.col("__m.licenses"), license=F.get(F.col("__m.licenses"), F.lit(0)), rest_ids=F.col("__m.rest"))
    return out.drop("__ids", "__m")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    join = lambda c: F.array_join(c, ",")
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"), join("sentence_ids").alias("sentence_ids"), join("licenses").alias("licenses"), "license", join("rest_ids").alias("rest_ids"))


def _sql() -> str:
    """The query in DuckDB's SQL, from the same tables of sentences and rules."""
    openings = [(n, "^" + p.replace(",?", "")) for n, p in SENTENCES]
    case = " ".join(f"WHEN regexp_matches(s, '{p.replace('(?![a-z0-9])', '( |$)')}') THEN '{n}'" for n, p in [*FIRST, *openings[:-1], *INSIDE, *openings[-1:]])
    cues = "|".join(re.sub(" ", "[ ]", c) for c in CUES) + "|spdx"
    left = "';' || array_to_string(ids, ';;') || ';'"
    steps = [f"m0 AS (SELECT doc_id, ids, CASE WHEN len(ids) = 0 THEN '' ELSE {left} END AS l, []::VARCHAR[] AS found FROM seq)"]
    for i, (name, ids) in enumerate(RULES):
        piece = "".join(f";{k};" for k in ids)
        steps.append(f"m{i + 1} AS (SELECT doc_id, ids, replace(l, '{piece}', ';|;') AS l, CASE WHEN contains(l, '{piece}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM m{i})")
    return rf"""
WITH sent AS (
  SELECT doc_id, i, trim(regexp_replace(translate(p[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS s
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
        FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[\x20\x09\x0B-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS p FROM documents))
), cut AS (
  SELECT doc_id, i, unnest(q) AS s, unnest(range(1, len(q) + 1)) AS j FROM (
    SELECT doc_id, i, CASE WHEN contains(s, 'under ') AND regexp_matches(s, ' (or|and|but) ')
      THEN flatten(list_transform(string_split(regexp_replace(s, '{_BUT}', 'Clicensed under ', 'g'), 'C'), lambda p: string_split(
        CASE WHEN regexp_matches(p, '{_UNDER}') AND NOT regexp_matches(p, '{DENIED}') THEN regexp_replace(p, '{_OR}', 'Clicensed under \1', 'g') ELSE p END, 'C')))
      ELSE [s] END AS q FROM sent WHERE s <> '')
), named AS (
  SELECT doc_id, i, j, CASE WHEN NOT regexp_matches(s, '{cues}') THEN NULL {case} END AS id FROM cut
), seq AS (
  SELECT d.doc_id, coalesce(list(n.id ORDER BY n.i, n.j) FILTER (WHERE n.id IS NOT NULL), []) AS ids FROM documents d LEFT JOIN named n ON n.doc_id = d.doc_id GROUP BY d.doc_id
), {", ".join(steps)}
SELECT doc_id, len(ids) AS n_known, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licenses, found[1] AS license,
       array_to_string(list_filter(string_split_regex(l, ';+'), lambda x: x <> '' AND x <> '|'), ',') AS rest_ids
FROM m{len(RULES)}
"""


OP8_SQL = _sql()
