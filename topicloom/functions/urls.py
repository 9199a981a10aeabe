"""Host names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host name parts taken as a sign of an English speaking site. They are
# looked for anywhere in the host name.
ENGLISH_HOST_PARTS = (
    r"\.com\.au|\.net\.au|\.org\.au|\.id\.au|\.com|\.gov|\.co\.uk|\.uk|\.gov\.uk|\.org\.uk|\.ie|\.nz"
)


def host_of(uri: Column) -> Column:
    """Host of a URI; null without a scheme or when the URI cannot be parsed."""
    return F.try_parse_url(uri, F.lit("HOST"))


def is_english_host(uri: Column) -> Column:
    return F.coalesce(F.rlike(host_of(uri), F.lit(ENGLISH_HOST_PARTS)), F.lit(False))


def site_of(host: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(host, r"^www\.", "")
