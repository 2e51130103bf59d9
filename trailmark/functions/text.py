"""Names, URLs and codes as expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """The list filter's folding: A-Z only. Groups fold with lower()."""
    return F.translate(c, UPPER, LOWER)


#: Query parameters whose values are secret.
SECRETS = ("password", "pass", "pwd", "token", "user", "key")


def redacted(url: Column, secrets: tuple[str, ...] = SECRETS) -> Column:
    """User info, up to the last @ before the path, and the values of secret query parameters hidden."""
    head, query = F.regexp_extract(url, r"(?s)^([^?]*)", 1), F.regexp_extract(url, r"(?s)^[^?]*(\?.*)?$", 1)
    head = F.regexp_replace(head, r"^((?:(?!://).)*://)[^/]*@", "$1***@")
    return F.concat(head, F.regexp_replace(query, rf"(?i)(?<=[?&])({'|'.join(secrets)})=[^&]*", "$1=***"))


def percent_encoded(c: Column) -> Column:
    """All but unreserved characters as %XX; a blank is %20."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def with_credentials(url: Column, user: Column, password: Column) -> Column:
    """user:password in front of the host, unless there are some or the URL is a file's."""
    has = url.rlike("^file:") | url.rlike("^[^:]+://[^/]*@")
    return F.when(has, url).otherwise(F.regexp_replace(url, "^([^:]+://)", F.concat(F.lit("$1"), percent_encoded(user), F.lit(":"), percent_encoded(password), F.lit("@"))))


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, "^([^:]+://)[^/@]*@", "$1")


def user_info(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "^[^:]+://([^/@]*)@", 1), F.lit(""))


def display_name(c: Column) -> Column:
    """Upper case for the first letter and no other change."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))


def same_name(a: Column, b: Column) -> Column:
    """Loose equality: one trimmed lower-cased name holds the other, neither is empty."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def full_class(ranks: list[Column]) -> Column:
    return F.concat_ws(";", *(F.coalesce(r, F.lit("")) for r in ranks))


def ancestor_key(ranks: list[Column], level: int) -> Column:
    """The ranks down to level joined, null if any of them is empty."""
    kept = ranks[:level]
    filled = F.lit(True)
    for r in kept:
        filled = filled & (r != "")
    return F.when(filled, F.concat_ws(";", *kept))


def valid_id(c: Column) -> Column:
    return c.rlike("^[a-z0-9_-]+$")


def label_or_error(c: Column, labels: tuple[str, ...]) -> Column:
    return F.when(c.isin(*labels), c).otherwise(F.raise_error(F.concat(F.lit("unknown label "), c)))


def backoff_seconds(n: Column) -> Column:
    return F.least(F.pow(F.lit(2), F.least(n, F.lit(5))), F.lit(30)).cast("long")


def nice_max(n: Column) -> Column:
    """The end of a chart's axis: the least of 5, 10, 20, 25, 50, 100, 200, 250, ... that is n or more."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(n, F.lit(1)).cast("double"))))
    steps = F.transform(F.array(*map(F.lit, (1.0, 2.0, 2.5, 5.0, 10.0))), lambda k: k * power)
    fits = F.filter(steps, lambda s: (s >= n) & (s % 5 == 0))
    return F.when(n <= 5, 5.0).otherwise(F.coalesce(F.array_min(fits), 10 * power)).cast("long")


def md5_hex(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def to_hex(c: Column) -> Column:
    """Bytes as digits in lower case."""
    return F.lower(F.hex(c.cast("binary")))


def from_hex(c: Column) -> Column:
    """The bytes that an even number of digits stands for, else null."""
    return F.when(c.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(c))


def clip_path(folder: str, day: Column, name: Column, suffix: str) -> Column:
    """A path below the data folder: folder, local day, name."""
    return F.concat_ws("/", F.lit(folder), F.date_format(day, "yyyy-MM-dd"), F.concat(name.cast("string"), F.lit(suffix)))


def password_digest(nonce: Column, created: Column, password: Column) -> Column:
    """SHA-1 over the nonce's bytes, the time as text and the password, in base 64."""
    return F.base64(F.unhex(F.sha1(F.concat(nonce.cast("binary"), created.cast("binary"), password.cast("binary")))))


def snapshot_channel(kind: Column, hub: Column, channel: Column, detect_url: Column) -> Column:
    """The channel that a hub's pictures of a camera come from: the camera's own, or one less than the two digits after
    Preview_ in its URL; null for cameras that are not streams (they must not be woken) or have no hub."""
    digits = F.regexp_extract(detect_url, "Preview_([0-9]{2})", 1).try_cast("int")
    return F.when((kind == "stream") & hub.isNotNull(), F.coalesce(channel, F.when(digits > 0, digits - 1)))


def full_stream_url(kind: Column, live: Column, full: Column) -> Column:
    """A stream camera's URL of full size, where that differs from the live one: the one given, else the live one's with
    _main for _sub if it is a Preview_ URL."""
    derived = F.when(F.endswith(live, F.lit("_sub")) & F.contains(live, F.lit("Preview_")), F.regexp_replace(live, "_sub$", "_main"))
    url = F.coalesce(full, derived)
    return F.when((kind == "stream") & (url != live), url)


def hub_live_url(kind: Column, hub_url: Column, user: Column, password: Column, channel: Column, main: bool) -> Column:
    """The stream of a battery camera at its hub: the host of the hub's web address, without scheme, credentials, port and
    path, and the camera's channel counted from 1."""
    authority = F.regexp_extract(F.regexp_replace(hub_url, "^.*?://", ""), "^([^/]*)", 1)
    host = F.regexp_extract(F.regexp_replace(authority, "^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1)
    url = F.concat(F.lit("rtsp://"), host, F.lit(":554/h264Preview_"), F.lpad((channel + 1).cast("string"), 2, "0"), F.lit("_main" if main else "_sub"))
    return F.when((kind == "hub_clips") & (host != "") & channel.isNotNull(), with_credentials(url, user, password))


def _hidden(value: object) -> object:
    """A JSON value without secrets, at any depth: the name in an object called Token, and whatever is called password."""
    if isinstance(value, list):
        return [_hidden(x) for x in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for key, inner in value.items():
        if key == "Token":
            out[key] = {**inner, "name": "REDACTED"} if isinstance(inner, dict) else inner
        else:
            out[key] = "REDACTED" if key.lower() == "password" else _hidden(inner)
    return out


def redacted_json(document: Column) -> Column:
    """A hub's answer as it may be kept: JSON without a token's name and without passwords at any depth, all else as it was and
    in its order, without blanks between. null for null and for what isn't JSON, which can't be searched for secrets."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_hidden(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    def hidden(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(hidden, "string")(document)
