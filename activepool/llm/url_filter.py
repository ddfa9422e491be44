"""URL filter by path-template trees, in DataFrame functions only.

Per host, each path becomes a template: segments whose form says that they vary (numbers, long
hexadecimal names, dates) become wildcards with their extension kept, and so does, level by level, any
place of the tree with too many distinct names. The last segment of a template is a leaf of the branch of
the segments before it. Sibling branches of one parent are merged when they are statistically alike, from
the deepest level up, so that parents are compared by what their merged children hold. Siblings with the same
commonest ending are one pool; a branch is alike to its pool if its counts of endings are at most a fixed
total variation from the pool's, and its share of blocked labels a fixed difference, each with an allowance
for the few pages or labels that it has. Rare endings weigh what they are, few labels say little and none
nothing, and at any size the same shares get the same answer up to that allowance.

Labels vote: a template's share of blocked votes is smoothed by its branch's, that by its host's and that by
the share over all hosts, and the template is rejected when enough labels make it high.

Given rules (verdict, host, path) decide the urls they fit; these urls are labels, too, beside a labels
table if one is given. All statistics are grouped counts, so a host with a third of all pages is combined
before it is shuffled, and the tree steps work on distinct templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from activepool.llm.common import picked
from activepool.session import pinned

#: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A place of the tree with more distinct names than this has a wildcard there.
MOST_NAMES = 64
#: Levels of the tree; segments between the last level and the leaf are one wildcard.
LEVELS = 4
#: Weight, in labels, of the share above a node; labels needed and share reached for a rejection.
PRIOR_WEIGHT = 5
LEAST_LABELS = 10
REJECT_SHARE = 0.8
#: Largest total variation of endings, and difference of blocked shares, of branches that are alike.
ALIKE = 0.2
ALIKE_LABELS = 0.1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/?#``, and the path up to ``?#``; else empty."""
    rest = F.get(F.split(url, "://", 2), F.lit(1))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits; null where none does."""

    def fits(h: str, p: str) -> Column:
        return ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))

    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest asks first
        rule = F.when(fits(h, p), F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits(h, p), F.lit(v)).otherwise(verdict)
    return rule, verdict


def _segment(name: Column) -> Column:
    """The segment, or a wildcard with its extension if its form says that it varies."""
    end = "(\\.[A-Za-z]{1,5})?\\z"
    varies = name.rlike("^[0-9]+" + end) | name.rlike("^[0-9a-fA-F-]{16,}" + end) | name.rlike("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?\\z")
    return F.when(varies, F.concat(F.lit("*"), F.regexp_extract(name, end, 1))).otherwise(name)


def _share(part: Column, of: Column, above: Column) -> Column:
    return (part + PRIOR_WEIGHT * above) / (of + PRIOR_WEIGHT)


def _merged_level(tree: DataFrame, k: int) -> DataFrame:
    """``tree`` with the k-th names of ``segs`` that are alike among siblings replaced by the first of them."""
    tree = pinned(tree, "url-merge")
    deep = tree.where(F.size("segs") >= k).select(
        "host", "n", "labelled", "blocked", F.array_join(F.slice("segs", 1, k - 1), "/").alias("parent"), F.get("segs", F.lit(k - 1)).alias("name"),
        F.concat(F.array_join(F.slice("segs", k + 1, LEVELS + 1), "/"), F.lit("/"), "leaf").alias("ending"),
    )
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    counts = deep.groupBy("host", "parent", "name", "ending").agg(*sums)
    branch = ["host", "parent", "name"]
    branches = counts.groupBy(*branch).agg(
        *[F.sum(c).alias(f"b_{c}") for c in ("n", "labelled", "blocked")], F.max_by("ending", F.struct("n", "ending")).alias("commonest")
    )
    counts = counts.join(branches, branch)
    pool = ["host", "parent", "commonest"]
    pooled = counts.groupBy(*pool, "ending").agg(F.sum("n").alias("p_n"))
    totals = counts.groupBy(*pool).agg(
        F.sum("n").alias("t_n"), F.sum("labelled").alias("t_labelled"), F.sum("blocked").alias("t_blocked"), F.count_distinct("ending").alias("endings")
    )
    common = F.least(F.col("n") / F.col("b_n"), F.col("p_n") / F.col("t_n"))
    seen = counts.join(pooled, [*pool, "ending"]).join(totals, pool)
    fits = seen.groupBy(*branch, "commonest").agg(
        F.round(1 - F.sum(common), 9).alias("variation"),
        *[F.max(c).alias(c) for c in ("b_n", "b_labelled", "b_blocked", "t_labelled", "t_blocked", "endings")],
    )
    share = F.col("t_blocked") / F.greatest("t_labelled", F.lit(1))
    gap = F.abs(F.col("b_blocked") / F.greatest("b_labelled", F.lit(1)) - share)
    votes = F.round(ALIKE_LABELS + 2 * F.sqrt(share * (1 - share) / F.greatest("b_labelled", F.lit(1))), 9)
    alike = (F.col("variation") <= F.round(ALIKE + F.sqrt(F.col("endings") / F.col("b_n")) / 2, 9)) & (
        (F.col("b_labelled") == 0) | (F.round(gap, 9) <= votes)
    )
    fits = pinned(fits.where(alike).select(*branch, "commonest"), "url-alike")
    first = fits.groupBy(*pool).agg(F.min("name").alias("first"))
    renamed = fits.join(first, pool).select("host", F.col("parent").alias("_parent"), F.col("name").alias("_name"), "first")
    named = tree.withColumn("_parent", F.when(F.size("segs") >= k, F.array_join(F.slice("segs", 1, k - 1), "/"))).withColumn(
        "_name", F.get("segs", F.lit(k - 1))
    )
    new = F.transform("segs", lambda s, i: F.when((i == k - 1) & F.col("first").isNotNull(), F.col("first")).otherwise(s))
    return named.join(renamed, ["host", "_parent", "_name"], "left").withColumn("segs", new).select(*tree.columns)


def template_tree(voted: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """(host, named, template, labelled, share) for each distinct path form of ``voted(host, named, vote)``.

    ``template`` is the merged branch with its leaf; ``share`` its smoothed share of blocked votes.
    """
    forms = voted.groupBy("host", "named").agg(
        F.count("*").alias("n"), F.count("vote").alias("labelled"), F.coalesce(F.sum("vote"), F.lit(0)).alias("blocked")
    )
    at = lambda k: F.get("named", F.lit(k))
    tree = forms.select("*", F.lit("").alias("branch"), F.coalesce(F.element_at("named", -1), F.lit("")).alias("leaf"))
    for k in range(LEVELS):
        tree = pinned(tree, "url-tree")
        is_dir = F.size("named") > k + 1  # the last entry is the leaf
        names = tree.where(is_dir).groupBy("host", "branch").agg(F.count_distinct(at(k)).alias("names"))
        tree = tree.join(names, ["host", "branch"], "left")
        name = F.when(F.col("names") > most_names, F.lit("*")).otherwise(at(k))
        tree = tree.select(
            "host", "named", "n", "labelled", "blocked", "leaf",
            F.when(is_dir, F.concat("branch", F.lit("/"), name)).otherwise(F.col("branch")).alias("branch"),
        )
    tree = pinned(tree, "url-tree")
    deep = F.size("named") > LEVELS + 1
    tree = tree.withColumn("branch", F.when(deep, F.concat("branch", F.lit("/**"))).otherwise(F.col("branch")))
    many = tree.groupBy("host", "branch").agg(F.count_distinct("leaf").alias("leaves"))
    tree = tree.join(many, ["host", "branch"]).withColumn(
        "leaf", F.when(F.col("leaves") > most_names, F.lit("*")).otherwise(F.col("leaf"))
    )

    segs = F.when(F.col("branch") == "", F.array().cast("array<string>")).otherwise(F.split(F.substring("branch", 2, 1 << 30), "/", -1))
    tree = tree.select("host", "named", "n", "labelled", "blocked", "leaf", segs.alias("segs"))
    for k in range(LEVELS + 1, 0, -1):
        tree = _merged_level(tree, k)
    placed = pinned(tree.withColumn("merged", F.concat_ws("", F.transform("segs", lambda s: F.concat(F.lit("/"), s)))).drop("segs"), "url-placed")
    votes = [F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    templates = placed.groupBy("host", "merged", "leaf").agg(*votes)
    branches = templates.groupBy("host", "merged").agg(F.sum("labelled").alias("b_labelled"), F.sum("blocked").alias("b_blocked"))
    hosts = branches.groupBy("host").agg(F.sum("b_labelled").alias("h_labelled"), F.sum("b_blocked").alias("h_blocked"))
    total = hosts.agg(F.coalesce(F.sum("h_blocked") / F.greatest(F.sum("h_labelled"), F.lit(1)), F.lit(0.0)).alias("t"))
    over_all = total.select("t").scalar()
    hosts = hosts.select("host", _share(F.col("h_blocked"), F.col("h_labelled"), over_all).alias("h_share"))
    branches = branches.join(hosts, "host").select(
        "host", "merged", _share(F.col("b_blocked"), F.col("b_labelled"), F.col("h_share")).alias("b_share")
    )
    judged = templates.join(branches, ["host", "merged"]).select(
        "host", "merged", "leaf", "labelled", _share(F.col("blocked"), F.col("labelled"), F.col("b_share")).alias("share")
    )
    return placed.select("host", "named", "merged", "leaf").join(judged, ["host", "merged", "leaf"]).select(
        "host", "named", F.concat("merged", F.lit("/"), "leaf").alias("template"), "labelled", "share"
    )


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labels: DataFrame | None = None,
    most_names: int = MOST_NAMES, least_labels: int = LEAST_LABELS, reject_share: float = REJECT_SHARE,
) -> DataFrame:
    """Every row of ``pages`` as (page_id, host, path, rule, verdict, template, labelled, share).

    ``labels`` may add (id_col, blocked 0/1) votes for urls without a rule. Where a rule fits, its verdict
    holds; else the template's: block if it has at least ``least_labels`` labels and its smoothed share
    of blocked ones reaches ``reject_share``.

    Edge cases: a null url or one without ``://`` has an empty host and path, which no rule fits, and is
    judged as the template of the empty host; repeated rows stay and vote once each; an empty table
    gives an empty one.
    """
    host, path = host_and_path(F.col("url"))
    rows = picked(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), ruled.alias("ruled"))
    vote = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    if labels is not None:
        own = picked(labels, __page=id_col, __blocked="blocked").groupBy("__page").agg(F.max("__blocked").alias("__blocked"))
        rows = rows.join(own, F.col("page_id") == F.col("__page"), "left")
        vote = F.coalesce(vote, F.col("__blocked"))
    # Segments as they are named in a template; the last entry is the leaf (empty for a path ending in /).
    named = F.transform(F.split(F.regexp_replace("path", "^/+", ""), "/+", -1), _segment)
    rows = rows.select("page_id", "host", "path", "rule", "ruled", vote.cast("int").alias("vote"), named.alias("named"))
    tree = template_tree(rows.select("host", "named", "vote"), most_names)
    rejected = (F.col("labelled") >= least_labels) & (F.col("share") >= reject_share)
    return rows.join(tree, ["host", "named"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(rejected, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", "labelled", "share",
    )
