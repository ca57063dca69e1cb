"""The top-level zones of the name system, from a public list that the machine holds; by rule where it holds none."""

from __future__ import annotations

import os
from functools import lru_cache

from . import patterns as P

#: Where systems keep the public suffix list. A file of one zone a line (the registry's own list) can be passed as well.
PLACES = ("/usr/share/publicsuffix/public_suffix_list.dat", "/usr/share/publicsuffix/effective_tld_names.dat")


def read(path: str) -> frozenset[str]:
    """The top-level zones of a public suffix list (its registry part) or of a list of one zone a line; `#` and `//` begin comments."""
    zones, known = set(), True
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            if line.startswith(("//", "#")):
                known = known and "===END ICANN DOMAINS===" not in line
            elif line and known:
                zones.add(line.split()[0].lower().lstrip("!*.").rsplit(".", 1)[-1])
    zones.discard("onion")  # its names are a type of their own
    return frozenset(z.encode("idna").decode() if not z.isascii() else z for z in zones) | frozenset(z for z in zones if not z.isascii())


@lru_cache(maxsize=1)
def known() -> frozenset[str] | None:
    """The zones of the first list in PLACES; None where there is none, and P.ZONE_RULE with P.GENERIC_ZONES decides."""
    path = next((p for p in PLACES if os.path.exists(p)), None)
    return None if path is None else read(path)


def is_zone(label: str, zones: frozenset[str] | None = None) -> bool:
    import re

    zones = zones or known()
    if zones is not None:
        return label in zones
    return bool(re.match(P.ZONE_RULE, label)) or label in P.GENERIC_ZONES or (not label.isascii() and label.isalpha())
