"""URL filter: explicit rules, and a path-template tree per host judged by labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrorisk.llm.common import as_rows, ascii_lower
from hydrorisk.session import settle

WILDCARD = "*"
END = ""
# Patterns of variable segments and what stands for them, tried in this order.
VARIABLE = (
    (r"^[0-9]+$", "{n}"),
    (r"^[0-9]+(\.[A-Za-z]{1,5})$", "{n}$1"),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "{uuid}"),
    (r"^(?=.*[0-9])[0-9a-fA-F]{8,}$", "{hex}"),
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def matching_rule(
    host: Column, path: Column, rules: Sequence[tuple[str, str, str]]
) -> tuple[Column, Column]:
    """(rule, action) of the longest rule (action, host, path) that fits; NULL where none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Of two
    equal rules ``block`` wins. Rules are an expression here: keep them to a few hundred.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block"))
    for act, rule_host, rule_path in order:
        at_host = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        fits = at_host & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def generalised(path: Column, depth: int) -> Column:
    """Path segments with numbers, ids and dates replaced; those from ``depth`` on are one tail."""

    def one(segment: Column) -> Column:
        for pattern, stands in VARIABLE:
            segment = F.regexp_replace(segment, pattern, stands)
        return segment

    segments = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), one)
    tail = F.array(F.array_join(F.slice(segments, depth, F.greatest(F.size(segments), F.lit(1))), "/"))
    return F.when(F.size(segments) <= depth, segments).otherwise(
        F.concat(F.slice(segments, 1, depth - 1), tail)
    )


def template_purity(
    urls: DataFrame, depth: int = 6, fan_out: int = 20, z: float = 1.96, smoothing: float = 5.0
) -> DataFrame:
    """(host, segments, template, purity) of distinct generalised paths of (host, segments, block).

    ``block`` is 1, 0 or NULL (no label). The tree grows level by level under each host.
    A node with more than ``fan_out`` children of under two urls on average has variable
    children: all merge into one wildcard branch. Elsewhere children without labels, and
    those whose labelled share does not differ from their siblings' (two proportions,
    ``z``), merge into it; the others stay branches of their own. Purity is the share of
    blocked labels below a branch, drawn towards its parent's by ``smoothing`` labels;
    the root is drawn towards one half. Counts are combined before each shuffle, and the
    loop runs over distinct templates, not pages.
    """
    state = settle(
        urls.groupBy("host", "segments")
        .agg(
            F.count(F.lit(1)).alias("urls"),
            F.count("block").alias("labelled"),
            F.coalesce(F.sum("block"), F.lit(0)).alias("blocked"),
        )
        .withColumn("template", F.col("host")),
        "templates",
    )
    n, b = state.agg(F.sum("labelled"), F.sum("blocked")).first()
    prior = ((b or 0) + smoothing * 0.5) / ((n or 0) + smoothing)
    state = _judged(state, F.lit(prior), smoothing)
    for level in range(depth):
        child = F.get("segments", level)
        branches = state.withColumn("child", child).filter("child IS NOT NULL")
        children = branches.groupBy("template", "child").agg(
            *[F.sum(c).alias(c) for c in ("urls", "labelled", "blocked")]
        )
        parents = children.groupBy("template").agg(
            F.count(F.lit(1)).alias("children"),
            F.sum("urls").alias("all_urls"),
            F.sum("labelled").alias("all_labelled"),
            F.sum("blocked").alias("all_blocked"),
        )
        others = F.col("all_labelled") - F.col("labelled")
        share = F.col("all_blocked") / F.col("all_labelled")
        error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / others))
        gap = F.abs(
            F.col("blocked") / F.col("labelled")
            - (F.col("all_blocked") - F.col("blocked")) / others
        )
        variable = (F.col("children") > fan_out) & (F.col("all_urls") < 2 * F.col("children"))
        # Shares of 0/0 are NULL without labels in the siblings: the only labelled child stays.
        own = (F.col("labelled") > 0) & ((others == 0) | F.coalesce(gap > z * error, F.lit(False)))
        kept = (
            children.join(parents, "template")
            .filter(own & ~variable)
            .select("template", "child", F.lit(True).alias("own"))
        )
        state = settle(
            state.withColumn("child", child)
            .join(kept, ["template", "child"], "left")
            .withColumn(
                "template",
                F.when(F.col("child").isNull(), F.col("template")).otherwise(
                    F.concat("template", F.lit("/"), F.when(F.col("own"), F.col("child")).otherwise(WILDCARD))
                ),
            )
            .drop("own"),
            "templates",
        )
        state = _judged(state, F.col("purity"), smoothing, F.col("child").isNotNull()).drop("child")
    return state.select("host", "segments", "template", "purity")


def _judged(
    state: DataFrame, parent: Column, smoothing: float, grown: Column | None = None
) -> DataFrame:
    """``purity`` of each row's branch, drawn towards ``parent``; rows that did not grow keep theirs."""
    grown = F.lit(True) if grown is None else grown
    sums = (
        state.filter(grown)
        .groupBy("template")
        .agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    )
    return (
        state.join(sums, "template", "left")
        .withColumn(
            "purity",
            F.when(grown, (F.col("b") + smoothing * parent) / (F.col("n") + smoothing)).otherwise(
                F.col("purity") if "purity" in state.columns else F.lit(None).cast("double")
            ),
        )
        .drop("n", "b")
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    url_col: str = "url",
    threshold: float = 0.5,
    depth: int = 6,
    fan_out: int = 20,
    z: float = 1.96,
    smoothing: float = 5.0,
) -> DataFrame:
    """All columns of ``pages`` plus host, path, rule, template, purity and verdict.

    A url that a rule (action, host, path) fits has the longest such rule's action; these
    urls are also the labels of the template tree. Any other url is blocked where the
    smoothed share of blocked labels of its template, ``purity``, is at least
    ``threshold``. NULL urls and urls without ``://`` have an empty host and path and
    are judged like a host of their own. Repeated rows are judged alike and count each; an
    empty table gives no rows; columns of ``pages`` named like the new ones are replaced.
    Starts jobs: distinct templates are stored in the shared folder at every level.
    """
    url = F.col(url_col).cast("string")
    rows = as_rows(pages, host=host_of(url), path=path_of(url))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns(
        {"rule": rule, "action": action, "segments": generalised(F.col("path"), depth)}
    )
    labels = rows.select(
        "host",
        "segments",
        F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", 0).alias("block"),
    )
    purity = settle(template_purity(labels, depth, fan_out, z, smoothing), "purity")
    verdict = F.coalesce(
        "action", F.when(F.col("purity") >= threshold, "block").otherwise("allow")
    )
    new = {
        "host": F.col("host"),
        "path": F.col("path"),
        "rule": F.col("rule"),
        "template": F.col("template"),
        "purity": F.col("purity"),
        "verdict": verdict,
    }
    plain = [c for c in pages.columns if c not in new]
    return rows.join(purity, ["host", "segments"]).select(
        *[F.col("row").getField(c).alias(c) for c in plain],
        *[column.alias(name) for name, column in new.items()],
    )
