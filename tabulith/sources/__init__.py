"""Sources and sinks of exchange rows."""
