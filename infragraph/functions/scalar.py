"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def edge_id(from_id: ColumnOrName, edge_type: ColumnOrName, to_id: ColumnOrName) -> Column:
    """``from->type->to``."""
    return F.concat_ws("->", _c(from_id), _c(edge_type), _c(to_id))


def first_non_empty(*values: ColumnOrName) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(_c(v), F.lit("")) for v in values], F.lit(""))


def meta_value(meta: ColumnOrName, *keys: str) -> Column:
    """The first non-empty value of a map, in the order of the keys, else the empty string."""
    return first_non_empty(*[_c(meta)[k] for k in keys])


def meta_true(meta: ColumnOrName, *keys: str) -> Column:
    return meta_value(meta, *keys) == "true"


def after_last(text: ColumnOrName, mark: str) -> Column:
    """What follows the last ``mark``; the whole text without one."""
    return F.substring_index(_c(text), mark, -1)


def candidate_variants(text: ColumnOrName) -> Column:
    """The text, and what follows its last slash, at sign and colon, where anything does."""
    c = _c(text)
    return F.filter(F.array(c, after_last(c, "/"), after_last(c, "@"), after_last(c, ":")), lambda x: x != "")


def normalize_identity_key(text: ColumnOrName) -> Column:
    """Lower case, runs of other than letters and digits as one dash, no dash at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.trim(_c(text))), r"[^\p{L}\p{Nd}]+", "-"), F.lit("-"))


def normalize_cycle(path: ColumnOrName) -> Column:
    """The cycle turned so that its smallest id comes first."""
    p = _c(path)
    at = F.array_position(p, F.array_min(p)).cast("int")
    turned = F.concat(F.slice(p, at, F.size(p)), F.slice(p, F.lit(1), at - 1))
    return F.when(F.size(p) > 0, turned).otherwise(p)


def labels_match(selector: ColumnOrName, labels: ColumnOrName) -> Column:
    """Every pair of the selector is among the labels; an empty selector matches nothing."""
    s, m = _c(selector), F.coalesce(_c(labels), F.create_map().cast("map<string,string>"))
    return F.coalesce((F.size(s) > 0) & F.forall(F.map_entries(s), lambda e: m[e["key"]].eqNullSafe(e["value"])), F.lit(False))


def potential_hosts(text: ColumnOrName) -> Column:
    """Distinct host names in a text, in its order and case: of URLs, and of bare ``user@host:port/path`` words.

    A word with several colons stays as it is, as an IPv6 address; brackets around one in a URL go.
    """
    words = F.filter(F.split(_c(text), r"[ \t\r\n,;]+"), lambda w: w != "")

    def of_url(word: Column) -> Column:
        place = F.regexp_replace(F.regexp_extract(word, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@", "")
        return F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\](:\d*)?$", 1)).otherwise(F.regexp_extract(place, r"^(.*?)(:\d*)?$", 1))

    def of_word(word: Column) -> Column:
        place = F.regexp_replace(F.substring_index(F.trim(word, F.lit("\"'()[]{}<>")), "/", 1), r"^[^@]*@", "")
        return F.when(F.regexp_count(place, F.lit(":")) == 1, F.substring_index(place, ":", 1)).otherwise(place)

    found = F.transform(words, lambda w: F.trim(F.trim(F.when(w.contains("://"), F.trim(of_url(w), F.lit("\"'()[]{}<>"))).otherwise(of_word(w))), F.lit(".")))
    return F.array_distinct(F.filter(found, lambda h: h != ""))


def image_uses_latest(image: ColumnOrName) -> Column:
    """No digest, and no tag after the last slash or the tag ``latest``."""
    i = F.trim(_c(image))
    name = after_last(i, "/")
    return (i != "") & ~i.contains("@sha256:") & (~name.contains(":") | (after_last(name, ":") == "latest"))


def sanitize_node_part(text: ColumnOrName) -> Column:
    """Lower case, with the characters that would break an id replaced."""
    return F.translate(F.lower(F.trim(_c(text))), " ./:@\\", "--____")


def split_targets(text: ColumnOrName) -> Column:
    """Targets separated by commas if there is one, else by white space."""
    c = _c(text)
    parts = F.when(c.contains(","), F.split(c, ",")).otherwise(F.split(c, r"\s+"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def k8s_service_id(target: ColumnOrName) -> Column:
    """``k8s:service:<namespace>/<name>`` from such an id, ``namespace/name`` or a name."""
    t = F.trim(_c(target))
    scoped = F.when(t.contains("/"), t).otherwise(F.concat(F.lit("default/"), t))
    return F.when(t.startswith("k8s:service:"), t).otherwise(F.concat(F.lit("k8s:service:"), scoped))


def redis_connection_string(service_id: ColumnOrName, port: ColumnOrName, db: ColumnOrName) -> Column:
    """The in-cluster address of a redis service id, with port 6379 and database 0 unless given; null without a namespace."""
    scoped = F.regexp_replace(_c(service_id), "^k8s:service:", "")
    ns, name = F.substring_index(scoped, "/", 1), F.substring_index(scoped, "/", -1)
    p, d = (F.coalesce(F.nullif(F.trim(_c(x)), F.lit("")), F.lit(default)) for x, default in ((port, "6379"), (db, "0")))
    return F.when(scoped.contains("/") & (ns != "") & (name != ""), F.concat(F.lit("redis://"), name, F.lit("."), ns, F.lit(".svc.cluster.local:"), p, F.lit("/"), d))


def days_until(expires: ColumnOrName, as_of: ColumnOrName) -> Column:
    """Whole days, truncated toward zero: 0 is less than a day either side."""
    return ((F.unix_micros(_c(expires)) - F.unix_micros(_c(as_of))) / F.lit(86_400_000_000)).cast("int")


def connection_like(key: ColumnOrName, value: ColumnOrName) -> Column:
    """A metadata entry that tells how to connect: by its key, or by a value with a scheme."""
    return F.lower(_c(key)).rlike(r"^(connection_string|database_url|db_url|redis_url|.*_url|.*_dsn)$") | _c(value).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
