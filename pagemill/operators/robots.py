"""Robots rules as a table, and the test of URLs against it (RFC 9309)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.columns import let
from pagemill.functions.urls import URL_PATTERN, url_host
from pagemill.operators.joins import BROADCAST_BYTES, PAGE_ROWS_PER_KEY, lookup_join, reliable_checkpoint

# Fixed values (RFC 3986): what a path cannot hold unescaped, and what needs no escape
UNSAFE = r"[^A-Za-z0-9\-._~!$&'()*+,;=:@/%?#\[\]]"
UNRESERVED = r"^[A-Za-z0-9\-._~]$"


def _directives(body: Column) -> Column:
    """``array<struct<key, value>>`` of the user-agent, allow and disallow lines."""

    def parse(line: Column) -> Column:
        bare = F.regexp_replace(line, r"#.*$|^\x{FEFF}", "")
        return F.struct(
            F.lower(F.regexp_extract(bare, r"^\s*([A-Za-z-]+)\s*:", 1)).alias("key"),
            F.regexp_extract(bare, r"^[^:]*:\s*(.*?)\s*$", 1).alias("value"),
        )

    return F.filter(
        F.transform(F.split(body, r"\r\n|\r|\n"), parse),
        lambda d: d["key"].isin("user-agent", "allow", "disallow"),
    )


def _groups(lines: Column) -> Column:
    """Lines cut into groups: a group starts at a user-agent line that does not follow another one."""
    starts = F.filter(
        F.transform(lines, lambda d, k: F.when(
            (d["key"] == "user-agent")
            & ((k == 0) | (F.get(lines, k - 1)["key"] != "user-agent")), k)),
        lambda k: k.isNotNull(),
    )
    return F.transform(
        starts,
        lambda s, k: F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s),
    )


def _agent_score(group: Column, agent: str) -> Column:
    """Length of the longest agent token of the group that fits, 0 for '*', -1 for none."""
    token = agent.lower()
    return F.array_max(
        F.transform(
            F.filter(group, lambda d: d["key"] == "user-agent"),
            lambda d: F.when(d["value"] == "*", 0)
            .when((d["value"] != "") & F.lit(token).startswith(F.lower(d["value"])), F.length(d["value"]))
            .otherwise(-1),
        )
    )


def normal_path(value: Column) -> Column:
    """One spelling for paths and patterns (RFC 9309, section 2.2.2): characters that a URL cannot hold are
    percent-encoded, escapes of unreserved characters are decoded, all other escapes have capital digits. An escaped
    ``*``, ``$`` or ``/`` thus stays different from the sign itself."""
    chars = F.transform(
        F.split(value, ""),
        lambda c: F.when(c.rlike(UNSAFE), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c),
    )
    encoded = F.when(value.rlike(UNSAFE), F.array_join(chars, "")).otherwise(value)

    def escape(part: Column, k: Column) -> Column:
        digits = F.upper(F.substring(part, 1, 2))
        sign = F.chr(F.conv(digits, 16, 10).cast("long"))
        rest = F.substring(part, F.lit(3), F.length(part))
        spelled = F.when(sign.rlike(UNRESERVED), F.concat(sign, rest)).otherwise(F.concat(F.lit("%"), digits, rest))
        return F.when(k == 0, part).when(digits.rlike("^[0-9A-F]{2}$"), spelled).otherwise(F.concat(F.lit("%"), part))

    return let(
        encoded,
        lambda e: F.when(e.contains("%"), F.array_join(F.transform(F.split(e, "%"), escape), "")).otherwise(e),
    )


def _rule(d: Column) -> Column:
    return let(F.struct(d["key"].alias("key"), d["value"].alias("raw"), normal_path(d["value"]).alias("value")), _compiled)


def _compiled(d: Column) -> Column:
    pattern = d["value"]
    anchored = pattern.endswith("$")
    core = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.replace(F.replace(core, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q"))
    regex = F.concat(F.lit("(?s)^\\Q"), quoted, F.lit("\\E"), F.when(anchored, F.lit("$")).otherwise(F.lit("")))
    return F.struct(
        d["raw"].alias("pattern"),
        (d["key"] == "allow").alias("allow"),
        F.regexp_extract(core, r"^[^*]*", 0).alias("prefix"),
        F.when(anchored | pattern.contains("*"), regex).alias("regex"),
        F.octet_length(pattern).alias("length"),
    )


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """Rules that apply to ``agent``: ``host, rules array<struct<pattern, allow, prefix, regex, length>>``.

    ``robots`` has ``host`` (with port), ``body`` and optionally ``status`` and ``fetched_at``. Of several captures of a
    host the latest counts (of equally late ones the greatest body); without times they must all be the same. The groups of the most specific
    agent token count, merged; else those of '*'. An empty pattern is no rule. A robots file is parsed inside
    its own row, so nothing is shuffled but one row per host.
    """
    usable = robots.filter(F.col("status") == 200) if "status" in robots.columns else robots
    if "fetched_at" in usable.columns:
        one_per_host = usable.groupBy("host").agg(F.max_by("body", F.struct("fetched_at", "body")).alias("body"))
    else:
        bodies = usable.groupBy("host").agg(F.min("body").alias("least"), F.max("body").alias("body"))
        several = F.raise_error(F.concat(F.lit("several robots files without fetched_at: "), F.col("host")))
        one_per_host = bodies.select(
            "host", F.when(F.col("least") == F.col("body"), F.col("body")).when(F.col("body").isNotNull(), several).alias("body")
        )
    lined = one_per_host.select("host", _directives(F.col("body")).alias("lines"))
    grouped = lined.select("host", _groups(F.col("lines")).alias("groups"))
    scored = grouped.select(
        "host",
        F.transform("groups", lambda g: F.struct(_agent_score(g, agent).alias("score"), g.alias("lines"))).alias("groups"),
    )
    best = F.array_max(F.transform("groups", lambda g: g["score"]))
    lines = F.flatten(
        F.transform(F.filter("groups", lambda g: (g["score"] == best) & (best >= 0)), lambda g: g["lines"])
    )
    rules = F.transform(F.filter(lines, lambda d: (d["key"] != "user-agent") & (d["value"] != "")), _rule)
    return scored.select("host", rules.alias("rules")).filter(F.size("rules") > 0)


def is_allowed(path: Column, rules: Column) -> Column:
    """Longest matching pattern decides, allow wins a tie, no match allows. ``path`` is in the form of `normal_path`."""
    hit = F.filter(
        rules,
        lambda r: path.startswith(r["prefix"]) & (r["regex"].isNull() | F.rlike(path, r["regex"])),
    )
    best = F.array_max(F.transform(hit, lambda r: F.struct(r["length"].alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


MANY_RULES = 100  # of a host; beyond them paths meet rules by equality of prefixes


def robots_allowed(
    pages: DataFrame,
    rules: DataFrame,
    max_bytes: int = BROADCAST_BYTES,
    rows_per_key: int = PAGE_ROWS_PER_KEY,
    url: str = "url",
    many: int = MANY_RULES,
) -> DataFrame:
    """``pages`` with ``allowed``. Only the path is tested, not the query; a host without rules allows all.

    Rules of a host with up to ``many`` are tested one after the other in the row of the page. Those of larger ones are
    found by join: the beginnings of a path, of the lengths that the rules of its host have, meet the rules that begin so
    (see `barred_by_index`). On a stream all are tested in the row.
    """
    if pages.isStreaming:
        return _allowed_in_row(pages, rules, max_bytes, rows_per_key, url, False)
    rules = reliable_checkpoint(rules)
    large = rules.filter(F.size("rules") > many)
    small = rules.filter(F.size("rules") <= many)
    judged = _allowed_in_row(pages, small, max_bytes, rows_per_key, url, True)
    if large.isEmpty():
        return judged
    barred = barred_by_index(pages.select(F.col(url).alias("url")), large, max_bytes, rows_per_key)
    barred = barred.select(F.col("url").alias(url), F.lit(True).alias("_barred"))
    marked = lookup_join(judged, barred, [url], "left", max_bytes, rows_per_key)
    columns = [F.col(f"`{c}`") for c in judged.columns if c != "allowed"]
    return marked.select(*columns, (F.col("allowed") & F.col("_barred").isNull()).alias("allowed"))


def _path(url: Column) -> Column:
    path = F.regexp_extract(url, URL_PATTERN, 4)
    return normal_path(F.when(path == "", "/").otherwise(path))


def _allowed_in_row(
    pages: DataFrame, rules: DataFrame, max_bytes: int, rows_per_key: int, url: str, materialized: bool
) -> DataFrame:
    tagged = pages.withColumn("host", url_host(F.col(url)))
    joined = lookup_join(tagged, rules, ["host"], "left", max_bytes, rows_per_key, materialized)
    allowed = let(_path(F.col(url)), lambda p: is_allowed(p, F.col("rules")))
    return joined.withColumn("allowed", allowed).drop("host", "rules")


def barred_by_index(
    urls: DataFrame, rules: DataFrame, max_bytes: int = BROADCAST_BYTES, rows_per_key: int = PAGE_ROWS_PER_KEY
) -> DataFrame:
    """The ``url`` of those that ``rules`` disallow, each once.

    A rule is found by its host and the literal it begins with, so a path costs as many look-ups as that host has
    different lengths of such literals, whatever the number of rules; a pattern with wildcards is tried on the paths
    that begin like it. Hot beginnings (``/`` of a large host) are split.
    """
    rule = F.explode("rules").alias("r")
    listed = rules.select("host", rule).select("host", "r.prefix", "r.regex", "r.length", "r.allow")
    listed = reliable_checkpoint(listed.distinct())
    lengths = listed.groupBy("host").agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))
    tagged = urls.distinct().withColumn("host", url_host(F.col("url")))
    tagged = lookup_join(tagged, lengths, ["host"], "inner", max_bytes, rows_per_key)
    pathed = tagged.select("url", "host", "lengths", _path(F.col("url")).alias("path"))
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    starts = pathed.select(
        "url", "host", "path", F.explode(F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("prefix")
    )
    starts = reliable_checkpoint(starts)
    met = lookup_join(starts, listed, ["host", "prefix"], "inner", max_bytes, rows_per_key, materialized=True)
    hit = met.filter(F.col("regex").isNull() | F.rlike(F.col("path"), F.col("regex")))
    best = hit.groupBy("url").agg(F.max(F.struct("length", "allow")).alias("best"))
    return best.filter(~F.col("best.allow")).select("url")
