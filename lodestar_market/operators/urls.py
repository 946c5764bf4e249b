"""One form for the URLs of one page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only say where a reader came from; a trailing * stands for anything.
TRACKING = ("utm_*", "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src", "referrer", "yclid", "_ga")
_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}


def canonical_url(url: Column) -> Column:
    """Scheme and host in small letters, no default port, credentials, fragment, tracking parameters or slash at the end; parameters sorted.

    What isn't an absolute URL, as an empty text or a path, stays as it is but
    for blanks around it.
    """
    part = lambda n: F.regexp_extract(url, _URL, n)
    scheme, host, port = F.lower(part(1)), F.regexp_replace(F.lower(part(2)), r"\.$", ""), part(3)
    default = F.lit(False)
    for name, number in _DEFAULT_PORTS.items():
        default = default | ((scheme == name) & (port == number))
    path = F.regexp_replace(part(4), r"/+$", "")
    names = "|".join(t.replace("*", "[^=]*") for t in TRACKING)
    kept = F.filter(F.split(part(5), "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^(?:{names})(?:=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    made = F.concat(scheme, F.lit("://"), host, F.when(default | (port == ""), "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(_URL), made).otherwise(F.trim(url))
