import re

from tabulith.llm import licenses as lic

MIT = """MIT License

Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.

The above copyright notice and this permission notice shall be included in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
TEXTS = {
    1: (MIT, ["MIT"]),
    2: ("Licensed under the Apache License, Version 2.0.\nSome text. More.", ["Apache-2.0"]),
    3: ("Some text.\nThis work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.", ["GPL-3.0", "MIT"]),
    4: ("Licensed under CC BY-NC 4.0. All rights reserved.", ["CC-BY-NC", "all-rights-reserved"]),
    5: ("A licence to drive. I had no permission.", []),
    6: ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that:\n1\nRedistributions of source code must retain the above copyright notice.\nRedistributions in binary form must reproduce the above copyright notice.\nNeither the name of X nor Y may be used to endorse or promote products.", ["BSD-3-Clause"]),
    7: (None, []),
    8: ("", []),
    9: ("w " * 100_000 + "\nReleased under the MIT License.", ["MIT"]),
    10: ("Released under the Foo Bar License.", ["other"]),
}


def brute(text):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    ids = []
    for s in re.split(r"\n|(?<=[.!?;:])[\x20\x09\x0B-\x0D]+", text or ""):
        s = re.sub("[^a-z0-9]+", " ", low(s)).strip()
        opening = [(n, "^" + p.replace(",?", "")) for n, p in lic.SENTENCES]
        ids += [n for n, p in [*lic.FIRST, *opening[:-1], *lic.INSIDE, *opening[-1:]] if re.search(p, s)][:1]
    left, found = list(ids), []
    for name, seq in lic.RULES:
        i, hit = 0, False
        while i + len(seq) <= len(left):
            if tuple(left[i : i + len(seq)]) == seq:
                left[i : i + len(seq)] = [None]
                hit = True
            i += 1
        if hit and name not in found:
            found.append(name)
    return ids, found, [x for x in left if x]


def test_rules(spark):
    rows = [(i, t, "kept") for i, (t, _) in TEXTS.items()] + [(2, TEXTS[2][0], "kept")]
    out = lic.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, License string"))
    assert sorted(out.columns) == ["doc_id", "license", "licenses", "rest_ids", "sentence_ids", "text"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.licenses == TEXTS[r.doc_id][1], r.doc_id
        assert (r.sentence_ids, r.licenses, r.rest_ids) == brute(TEXTS[r.doc_id][0])
    assert lic.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_every_sentence_has_a_cue():
    for name, p in lic.SENTENCES:
        fixed = re.sub(r"\([^)]*\)\??|\.\*|[\\,?|]", " ", p.replace("(?:", "("))
        words = p.replace("licen[sc]e", "license").replace(",?", "")
        assert any(c in words or c in fixed for c in (*lic.CUES, "spdx")), name


WRAPPED = {
    "mit": ("""# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in
# all copies or substantial portions of the Software.
#
# THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
# IMPLIED.""", ["MIT"], []),
    "bsd": ("""/*
 * Copyright (c) 2024 Someone
 * All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 * 1. Redistributions of source code must retain the above
 *    copyright notice, this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright
 *    notice in the documentation.
 * 3. Neither the name of X nor the names of its contributors
 *    may be used to endorse or promote products.
 *
 * THIS SOFTWARE IS PROVIDED BY THE AUTHORS "AS IS" AND ANY EXPRESS
 * OR IMPLIED WARRANTIES ARE DISCLAIMED.
 */""", ["BSD-3-Clause", "all-rights-reserved"], []),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", ["ISC"], []),
    "mpl": ("dnl This Source Code Form is subject to the terms of the Mozilla Public\ndnl License, v. 2.0. If a copy of the MPL was not distributed with this\ndnl file, You can obtain one at\nhttps://mozilla.org/MPL/2.0/.", ["MPL-2.0"], []),
    "gpl": ("x\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, version 3.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty.", ["GPL"], []),
    "gpl, one line": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", ["GPL"], []),
    "after a colon": ("The terms: Redistribution and use in source and binary forms, with or without modification, are permitted; Redistributions of source code must retain the above copyright notice; Redistributions in binary form must reproduce the above copyright notice.", ["BSD-2-Clause"], []),
    "line end": ("You may obtain a copy of the License at\n\nhttp://x", [], ["apache2_obtain"]),
    "spdx": ("// SPDX-License-Identifier: MIT\nint main", ["MIT"], []),
    "spdx expression": ("# (c) SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) OR Apache-2.0", ["Apache-2.0", "GPL-2.0"], []),
    "spdx, other": ("SPDX-License-Identifier: MIT-0", ["other"], []),
}


def test_wrapped_texts_and_tags(spark):
    docs = spark.createDataFrame([(k, t.replace("\n", e)) for k, (t, _, _) in WRAPPED.items() for e in ("\n", "\r\n")], "name string, text string")
    for r in lic.scan_licenses(docs).collect():
        assert (r.licenses, r.rest_ids) == WRAPPED[r.name][1:], (r.name, r.sentence_ids)


# Texts as they are found in files, written down from the licences themselves, not from the library's tables.
FOUND = [
    ("MIT License", "MIT"),
    ("The MIT License (MIT)\n\nCopyright (c) 2019 A. Author", "MIT"),
    ("ISC License\n\nCopyright (c) 2020, Someone\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice appears.", "ISC"),
    ("This library is licensed under LGPL-2.1.", "LGPL"),
    ("Eclipse Public License - v 2.0 applies.", "EPL-2.0"),
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-3.0-only */", "GPL-3.0"),
    ("# SPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
    ("# SPDX-License-Identifier: BSL-1.0", "BSL-1.0"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY", "LGPL"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation.", "AGPL"),
    ("You should have received a copy of the GNU General Public License\nalong with this program.", "GPL"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications", "Zlib"),
    ("Code is released under the MIT license, docs are not.", "MIT"),
    ("All modules are available under the terms of the GNU GPL v2.", "GPL-2.0"),
    ("The package may be used under the terms of the Apache License 2.0.", "Apache-2.0"),
    ("Apache License, Version 2.0, January 2004", "Apache-2.0"),
    ("Our data are published under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA"),
    ("Text is available under CC BY-NC-ND 4.0", "CC-BY-NC-ND"),
    ("It is covered under the 3-clause BSD license.", "BSD"),
    ("BSD 2-Clause License\n\nCopyright (c) 2021, X", "BSD-2-Clause"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
    ("Mozilla Public License Version 2.0\n==================================", "MPL-2.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Licensed under the EUPL, Version 1.2 only.", "EUPL"),
    ("This file may be redistributed under the Artistic License 2.0.", "Artistic"),
    ("The tool is licensed under the Common Development and Distribution License.", "CDDL"),
    ("Mozilla Public License Version 1.1", "MPL-1.1"),
    ("The contents of this file are subject to the Mozilla Public License\nVersion 1.0 (the \"License\")", "MPL-1.0"),
    ("Eclipse Public License - v 1.0", "EPL-1.0"),
    ("# SPDX-License-Identifier: EPL-1.0", "EPL-1.0"),
    ("# SPDX-License-Identifier: MPL-1.1", "MPL-1.1"),
    ("MIT No Attribution", "MIT-0"),
    ("Creative Commons Legal Code\n\nCC0 1.0 Universal", "CC0"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "OFL"),
    ("PostgreSQL License", "PostgreSQL"),
    ("Permission to use, copy, modify, and distribute this software and its documentation for any\npurpose, without fee, and without a written agreement is hereby granted", "PostgreSQL"),
    ("Permission to use, copy, modify, and distribute this software for any purpose\nwith or without fee is hereby granted", "ISC"),
    ("Redistributed under the OpenSSL license.", "OpenSSL"),
    ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "WTFPL"),
    ("Code is released under the Microsoft Public License (Ms-PL).", "MS-PL"),
    ("Licensed under the Universal Permissive License v 1.0", "UPL"),
    ("The library is not licensed under the MIT license but under the Apache License 2.0.", "Apache-2.0"),
    ("The data is not licensed under the MIT license or the GPL.", None),
    ("This file is not licensed under the MIT license.", None),
    ("Ours is unlike code released under the GPL.", None),
    ("It may not be distributed under the GNU General Public License.", None),
    ("The contents are dedicated to nobody in particular; permission to enter was denied.", None),
    ("He submitted the licence application under the old rules.", None),
    ("Released under water, the admit card smelled of license.", None),
]


def test_texts_as_found(spark):
    docs = spark.createDataFrame(list(enumerate(t for t, _ in FOUND)), "doc_id int, text string")
    got = {r.doc_id: r.licenses for r in lic.scan_licenses(docs).collect()}
    for i, (text, name) in enumerate(FOUND):
        assert (name in got[i]) if name else not got[i], (text, got[i])


def test_each_license_of_a_sentence(spark):
    mit0 = MIT.replace("MIT License", "MIT No Attribution").replace("to deal in the Software without restriction", "and to permit persons to whom the Software is furnished to do so").replace("The above copyright notice and this permission notice shall be included in all copies.\n\n", "")
    texts = {
        "Dual licensed under the MIT or GPL Version 2 licenses.": {"MIT", "GPL-2.0"},
        "Licensed under either of the Apache License, Version 2.0 or the MIT license at your option.": {"Apache-2.0", "MIT"},
        "It is available under the terms of the MPL 1.1, or the GNU LGPLv2 and the GPL v3.": {"MPL-1.1", "LGPL", "GPL-3.0"},
        "Not under the GPL but under the MIT license.": {"MIT"},
        "Released under the MIT license and contains no BSD code.": {"MIT"},
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.": {"GPL"},
        mit0: {"MIT-0"},
    }
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: set(r.licenses) for r in lic.scan_licenses(docs).collect()}
    assert got == texts
