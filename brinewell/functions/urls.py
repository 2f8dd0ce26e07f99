"""URLs: normalisation and admission, and what their canonical form tells.

Normalisation follows the URL standard, which no SQL function does, in one Arrow UDF; everything that works on canonical
URLs is built-in expressions.
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, decoded

MAX_URL = 2048
#: Internal names, tracking parameters, and the patterns of traps and of pages without content.
INTERNAL_SUFFIXES = (".localhost", ".local", ".internal", ".lan", ".home.arpa")
TRACKING = "^(utm_[a-z0-9_]+|fbclid|gclid|dclid|msclkid|mc_eid|mc_cid|igshid|yclid|_hsenc|_hsmi)$"
HOST_CODES = (
    "aa ab af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz "
    "ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os "
    "pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu simple"
).split()
HOST_AMBIGUOUS = (
    "my me to go do as so or in us am be hi he is la na on se st wa ha uk ca ch tw sg kr ie lu za cs au nz eu cn br mx ar sa ae il gr at dk fi pl ro cz hu tr ru ua jp vn ph id th hk pk ng ke eg"
).split()
PATH_AMBIGUOUS = "is it no to my me be am as so or id in us he hi do go ha la na on se st ti ty wa ye nd ng li lo mi ne oc os pa pi ps qu re ss ts tt tw ug za".split()
BINARY_EXTENSION = r"(?i)\.(jpe?g|png|gif|webp|svg|ico|bmp|tiff?|mp3|mp4|m4a|ogg|ogv|webm|avi|mov|wav|flac|zip|gz|tgz|bz2|xz|7z|rar|tar|iso|dmg|exe|msi|apk|deb|rpm|pdf|docx?|xlsx?|pptx?|odt|ods|epub|woff2?|ttf|otf|eot|css|js|json|xml|rss|atom)$"
NOISE_PARAMETER = "(?i)^(action|oldid|diff|veaction|printable|redirect|useskin|uselang|mobileaction|do|replytocom|share|print)$"
NOISE_PATH = r"(?i)(^|/)(special:[^/]*|spezial:[^/]*|login|logout|signin|signup|register|cart|checkout|wp-admin|wp-login\.php|feed|rss|print|raw|share)(/|$)"
SOFT_404 = r"(?i)\b(page not found|not found|404|no longer available|does not exist|doesn['’]t exist|nothing (was )?found|error 404|page you (are looking for|requested))\b"
SESSION_OR_FILTER = "(?i)^(sort|sortby|sort_by|order|orderby|order_by|dir|filter|filters|facet|facets|fq|session|sessionid|session_id|sid|phpsessid|jsessionid|aspsessionid|replytocom|share|print|format)$"
PATH_SESSION = "(?i);(jsessionid|sessionid|sid|phpsessid)="
CALENDAR_PATH = "(?i)(^|/)(calendar|calendars|events|event|agenda|archive|archives)(/|$)"
DATE_PARAMETER = "(?i)^(year|month|day|week|date|d|m|y|start|from|end|to|cal|calendar|ical|outlook-ical)$"
DATE_SEGMENT = r"^(\d{4}|\d{4}-\d{2}(-\d{2})?|\d{1,2})$"
MAX_SEGMENTS, MAX_PARAMETERS, MAX_QUERY, MAX_PAGE, MAX_SEGMENT = 10, 5, 160, 20, 120

_TRACKING = re.compile(TRACKING, re.I)
_CONTROL = re.compile(r"[\x00-\x1f\x7f\\]")
#: Percent-encoded in a path and in a query of a special scheme by the URL standard, beside anything outside ASCII.
_IN_PATH, _IN_QUERY = set(' "#<>?`{}^'), set(" \"#<>'")


def _percent(text: str, unsafe: set[str]) -> str:
    return "".join(c if " " <= c < "\x7f" and c not in unsafe else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _escapes(text: str) -> str:
    """Escapes of unreserved characters decoded, the hex of the others in upper case."""
    return re.sub("%([0-9a-fA-F]{2})", lambda m: c if re.match(r"[A-Za-z0-9\-._~]", c := chr(int(m[1], 16))) else "%" + m[1].upper(), text)


def _ipv4(host: str) -> bool:
    """Whether the URL standard reads the host as an IPv4 address: its last label is a number."""
    last = host.removesuffix(".").rpartition(".")[2]
    return bool(re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", last))


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        if plain == "..":
            out = out[:-1]
        elif plain != ".":
            out.append(part)
            continue
        if i == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def parse_crawl_url(raw: str | None, base: str | None = None, extra_tracking: tuple[str, ...] = ()) -> tuple[str | None, str | None, str | None, str | None]:
    """(url, host, origin, None) of an admissible address in canonical form, or (None, None, None, reason)."""

    def no(reason: str):
        return None, None, None, reason

    if raw is None:
        return no("MALFORMED")
    if len(raw) > 2 * MAX_URL:
        return no("TOO_LONG")
    text = raw.strip()
    if _CONTROL.search(text):
        return no("CONTROL_CHARS")
    try:
        scheme = m[1].lower() if (m := re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", text)) else None
        if scheme in ("http", "https"):
            rest = text[m.end() :]
            if base and not rest.startswith("/") and base.lower().startswith(scheme + ":"):
                text = urljoin(base, rest or ".")  # a relative reference with a scheme
            else:
                text = f"{scheme}://{rest.lstrip('/')}"
        elif scheme:
            return no("SCHEME")
        elif base:
            text = urljoin(base, text)
        else:
            return no("MALFORMED")
        if not re.match("(?i)https?://", text):
            return no("SCHEME")
        parts = urlsplit(text)
        authority = parts.netloc
        user, at, place = authority.rpartition("@")
        if place.startswith("["):
            return no("CREDENTIALS") if at and user not in ("", ":") else no("IP_LITERAL")
        host, colon, port = place.partition(":")
        if colon and port and not (port.isascii() and port.isdigit() and int(port) < 65536):
            return no("MALFORMED")
        host = re.sub("%([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), host).lower()
        if not host.isascii():
            host = host.replace("。", ".").encode("idna").decode()
        if not host or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]", host) or ".." in host:
            return no("MALFORMED")
    except (ValueError, UnicodeError):
        return no("MALFORMED")
    if at and user not in ("", ":"):
        return no("CREDENTIALS")
    host = host.removesuffix(".")
    if _ipv4(host):
        return no("IP_LITERAL")
    if "." not in host or host.endswith(INTERNAL_SUFFIXES):
        return no("INTERNAL_HOST")
    if port and int(port) != {"http": 80, "https": 443}[parts.scheme]:
        return no("PORT")
    query = _percent(parts.query, _IN_QUERY)
    pairs = parse_qsl(query, keep_blank_values=True, errors="replace") if query else []
    kept = [(k, v) for k, v in pairs if not _TRACKING.match(k) and k.lower() not in extra_tracking]
    if len(kept) != len(pairs):
        query = "&".join(f"{_form(k)}={_form(v)}" for k, v in kept)
    url = f"{parts.scheme}://{host}{_escapes(_dots(_percent(parts.path or '/', _IN_PATH)))}" + (f"?{_escapes(query)}" if query else "")
    if len(url) > MAX_URL:
        return no("TOO_LONG")
    return url, host, f"{parts.scheme}://{host}", None


def _form(text: str) -> str:
    return quote_plus(text, safe="*").replace("~", "%7E")


PARSED = "url string, host string, origin string, reason string"


def normalize(raw: Column, base: Column | None = None, extra_tracking: tuple[str, ...] = ()) -> Column:
    """Struct (url, host, origin, reason) of an address, resolved against base."""

    @F.pandas_udf(PARSED)
    def udf(raw: pd.Series, base: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_crawl_url(r, b, extra_tracking) for r, b in zip(raw, base)], columns=["url", "host", "origin", "reason"])

    return udf(raw, F.lit(None).cast("string") if base is None else base)


def url_key(url: Column) -> Column:
    return F.sha2(url, 256)


def idempotency_key(url: Column, generation: Column) -> Column:
    return F.concat(F.lit("crawl:"), F.substring(url_key(url), 1, 32), F.lit(":"), generation.cast("string"))


def valid_idempotency_key(key: Column) -> Column:
    return F.coalesce(key.rlike("^crawl:[0-9a-f]{32}:[0-9]+$") & (F.char_length(key) <= 128), F.lit(False))


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    """The query with its question mark, or empty."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1)


def parameters(url: Column) -> Column:
    """Array of (key, value) of the query, decoded as a form."""
    pairs = F.filter(F.split(F.substring(query_of(url), 2, MAX_URL * 2), "&"), lambda p: p != "")

    def part(p: Column, i: int) -> Column:
        text = F.regexp_extract(p, r"^([^=]*)=?(.*)$", i)
        return F.coalesce(F.try_url_decode(text), text)

    return F.transform(pairs, lambda p: F.struct(part(p, 1).alias("key"), part(p, 2).alias("value")))


def strip_tracking(query: Column, extra: tuple[str, ...] = ()) -> Column:
    """A query string (no question mark) without tracking parameters, the others as they stand."""
    pattern = "(?i)" + TRACKING
    drop = lambda p: F.split(p, "=")[0].rlike(pattern) | F.lower(F.split(p, "=")[0]).isin(*extra) if extra else F.split(p, "=")[0].rlike(pattern)
    return F.array_join(F.filter(F.split(query, "&"), lambda p: ~drop(p)), "&")


def variant_key(url: Column) -> Column:
    """The same for http and https, with and without www., with and without slashes at the end."""
    rest = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), r"^www\.", "")
    split = F.regexp_extract(rest, r"^([^?]*)", 1)
    return F.when(url.rlike("^https?://[^/?#]+"), F.concat(F.regexp_replace(split, "/+$", ""), F.regexp_extract(rest, r"^[^?]*(\?.*)$", 1))).otherwise(url)


def segments(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def language_hint(url: Column) -> Column:
    """Primary language subtag that the first host label or path segment hints at, or null."""
    labels = F.split(host_of(url), r"\.")
    first = labels[0]
    base = F.split(first, "-")[0]
    plain = first.isin(*HOST_CODES) & ~first.isin(*HOST_AMBIGUOUS)
    by_host = (F.size(labels) >= 3) & (plain | (base.isin(*HOST_CODES) & first.rlike("^[a-z]{2}-[a-z]{2,}$")))
    segment = F.lower(F.coalesce(F.get(F.split(path_of(url), "/"), F.lit(1)), F.lit("")))
    primary = F.split(segment, "[-_]")[0]
    by_path = segment.rlike("^[a-z]{2}([-_][a-z]{2})?$") & primary.isin(*HOST_CODES) & ~primary.isin(*PATH_AMBIGUOUS)
    return F.when(by_host, F.when(base == "simple", "en").otherwise(base)).when(by_path, primary)


def language_preferred(language: Column, preferred: tuple[str, ...]) -> Column:
    """Unknown languages are always fine."""
    if "*" in preferred:
        return F.lit(True)
    primary = F.split(F.lower(language), "[-_]")[0]
    return F.coalesce((primary == "") | primary.isin(*preferred), F.lit(True))


def low_value_reason(url: Column) -> Column:
    return (
        F.when(path_of(url).rlike(BINARY_EXTENSION), "NON_HTML_FILE")
        .when(F.exists(parameters(url), lambda p: p["key"].rlike(NOISE_PARAMETER)), "NOISE_PARAM")
        .when(decoded(path_of(url)).rlike(NOISE_PATH), "NOISE_PATH")
    )


def soft_404(title: Column, text: Column, links: Column) -> Column:
    return (F.char_length(text) <= 600) & (links <= 12) & (title.rlike(SOFT_404) | F.substring(text, 1, 300).rlike(SOFT_404))


def thin(text: Column, links: Column) -> Column:
    return (F.char_length(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")) < 40) & (links < 3)


def _number(text: Column) -> Column:
    """A parameter's number; the empty string is 0, anything else that is no number is null."""
    return F.when(F.trim(text) == "", 0.0).otherwise(F.trim(text).try_cast("double"))


def trap_reason(url: Column) -> Column:
    """The first crawl-trap rule that holds, or null."""
    parts, given = segments(url), parameters(url)
    keys = F.transform(given, lambda p: p["key"])
    values = F.filter(F.transform(given, lambda p: p["value"]), lambda v: v != "")
    dates = F.size(F.filter(keys, lambda k: k.rlike(DATE_PARAMETER)))
    date_segments = F.size(F.filter(parts, lambda s: s.rlike(DATE_SEGMENT)))
    first_value = lambda k: F.get(F.filter(given, lambda p: p["key"] == k), F.lit(0))["value"]
    deep = F.exists(keys, lambda k: k.rlike("(?i)^(page|paged|p|start|offset)$") & F.coalesce(_number(first_value(k)) > F.when(F.lower(k).isin("start", "offset"), 10 * MAX_PAGE).otherwise(MAX_PAGE), F.lit(False)))
    page = F.array_position(F.transform(parts, lambda s: F.lower(s)), "page").cast("int")
    deep_path = (page > 0) & F.coalesce(_number(F.get(parts, page)) > MAX_PAGE, F.lit(False))
    return (
        F.when(F.size(parts) > MAX_SEGMENTS, "TOO_MANY_SEGMENTS")
        .when(F.exists(parts, lambda s: F.size(F.filter(parts, lambda t: t == s)) >= 3), "REPEATING_SEGMENTS")
        .when(F.exists(parts, lambda s: F.char_length(s) > MAX_SEGMENT), "LONG_SEGMENT")
        .when(path_of(url).rlike(PATH_SESSION), "PATH_SESSION")
        .when((F.size(values) >= 3) & (F.size(F.array_distinct(values)) == 1), "REPEATED_PARAM_VALUE")
        .when(F.size(keys) > MAX_PARAMETERS, "TOO_MANY_PARAMS")
        .when(F.char_length(query_of(url)) > MAX_QUERY, "LONG_QUERY")
        .when(F.exists(keys, lambda k: k.rlike(SESSION_OR_FILTER)), "SESSION_OR_FILTER_PARAM")
        .when(path_of(url).rlike(CALENDAR_PATH) & ((dates > 0) | (date_segments >= 2)), "CALENDAR")
        .when(dates >= 2, "CALENDAR")
        .when(deep | deep_path, "DEEP_PAGINATION")
    )


def query_intent(raw: Column) -> Column:
    """'url' if a query is an address or a dotted name with an alphabetic end, else 'informational'."""
    q = F.trim(raw)
    address = F.when(q.rlike("(?i)^https?://"), q).otherwise(F.concat(F.lit("https://"), q))
    host = normalize(address)["host"]
    plausible = (q != "") & ~q.rlike(r"\s") & (F.char_length(q) <= 253)
    dotted = host.rlike(r"(?i)^[a-z0-9-]+(\.[a-z0-9-]+)+$") & host.rlike("(?i)[a-z]{2,}$")
    return F.when(F.coalesce(plausible & dotted, F.lit(False)), "url").otherwise("informational")


def register(spark) -> None:
    """The UDFs under names for SQL."""
    from .text import decomposed, fold

    spark.udf.register("fold_text", fold)
    spark.udf.register("decompose_text", decomposed)

    @F.pandas_udf(PARSED)
    def normalize_url(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_crawl_url(r) for r in raw], columns=["url", "host", "origin", "reason"])

    spark.udf.register("normalize_url", normalize_url)
