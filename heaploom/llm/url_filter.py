"""URL filter by a path-template tree for each host.  DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, cut, hinted
from .decontaminate import ascii_lower


class Rule(NamedTuple):
    """What a host and its subdomains may serve under paths that start with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query (fixed values).
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]
#: Segments that a tree tells apart; what lies deeper is one wildcard.
DEPTH = 6
#: A node of more children than this turns those into a wildcard that have less than this part of its URLs.
VARIETY = 20
#: Labelled URLs that weigh as much as what is known of the node above; least own labels, and purity from which a template is rejected.
SMOOTHING, EVIDENCE, PURITY = 5.0, 3, 0.8
#: How many standard deviations a branch may lie off its siblings' common distribution and still be merged with them.
DEVIATIONS = 3.0
#: A branch is unlabelled if less of it is labelled, else unwanted or wanted if so much of what is labelled is.
LABELLED, DOMINANT = 0.1, 2 / 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) after the first ://, and the path up to ? or #; both empty without ://, or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (by its name) that fits, as a struct (length, rule, action, host, path); null where none does."""
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,action:string,host:string,path:string>")
    every = F.array(*[F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path")) for r in rules])
    return F.array_max(F.filter(every, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])))


def segments(path: Column) -> Column:
    """The segments of a path with numbers, hexadecimal names and very long names as wildcards; those below DEPTH are one."""
    parts = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(path, "^/", ""), "/"))

    def general(s: Column) -> Column:
        named = F.when(F.length(s) > 40, F.lit("{s}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))
        return F.when(s.rlike("^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F-]{8,}$"), F.lit("{h}")).otherwise(named)

    known = F.transform(F.slice(parts, 1, DEPTH), general)
    return F.when(F.size(parts) > DEPTH, F.concat(known, F.array(F.lit("{...}")))).otherwise(known)


def _outcome(n: Column, bad: Column, good: Column) -> Column:
    known = bad + good
    return F.when(known < LABELLED * n, "unlabelled").when(bad >= DOMINANT * known, "unwanted").when(good >= DOMINANT * known, "wanted").otherwise("mixed")


def _within(chi: Column, free: Column) -> Column:
    """Whether a chi-square value is no more than DEVIATIONS standard deviations above its mean."""
    return chi <= free + DEVIATIONS * F.sqrt(2.0 * free) + 1e-9


def _sums() -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in ("n", "bad", "good")]


def _generalised(work: Workspace, tree: DataFrame, level: int) -> DataFrame:
    """One level of the tree: rare children of nodes of very many become a wildcard, and then branches that look alike one branch.

    ``tree``: key, host, segs (generalised down to this level), n, bad, good.
    """
    deep = F.size("segs") > level
    node = F.concat_ws("/", F.slice("segs", 1, level)).alias("node")
    child = F.element_at("segs", level + 1)
    branches = tree.where(deep).select("host", node, child.alias("child"), F.coalesce(F.try_element_at("segs", F.lit(level + 2)), F.lit("")).alias("next"), "n", "bad", "good")
    shapes = work.keep(branches.groupBy("host", "node", "child", "next").agg(*_sums()))
    children = shapes.groupBy("host", "node", "child").agg(*_sums())

    nodes = children.groupBy("host", "node").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("total")).where(F.col("children") > VARIETY)
    rare = children.join(work.sized(nodes), ["host", "node"]).where(F.col("n") * VARIETY < F.col("total")).select("host", "node", "child", F.lit("{*}").alias("general"))
    rare = work.keep(rare)

    # What is left: each branch against all its siblings of the same outcome, by chi-square tests over what follows it and over its labels.
    rest = shapes.join(hinted(rare.drop("general")), ["host", "node", "child"], "left_anti")
    group = ["host", "node", "outcome"]
    own = rest.groupBy("host", "node", "child").agg(*_sums())
    own = work.keep(own.withColumn("outcome", _outcome(F.col("n"), F.col("bad"), F.col("good"))))
    whole = own.groupBy(*group).agg(F.sum("n").alias("all"), F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"), F.count(F.lit(1)).alias("siblings")).where("siblings > 1")
    whole = work.sized(whole.drop("siblings"))
    placed = work.keep(rest.join(hinted(own.select("host", "node", "child", "outcome")), ["host", "node", "child"]).select(*group, "child", "next", "n"))
    # What rarely follows is one kind: it becomes a wildcard on the next level.
    often = placed.groupBy(*group, "next").agg(F.sum("n").alias("m")).join(whole, group).where(F.col("m") * VARIETY >= F.col("all")).select(*group, "next", F.col("next").alias("kind"))
    kinds = placed.join(work.sized(often), [*group, "next"], "left").groupBy(*group, "child", F.coalesce("kind", F.lit("{*}")).alias("kind")).agg(F.sum("n").alias("n"))
    kinds = work.keep(kinds)
    shares = kinds.groupBy(*group, "kind").agg(F.sum("n").alias("m")).join(whole, group).select(*group, "kind", (F.col("m") / F.col("all")).alias("share"))
    shares = work.sized(shares)
    number = shares.groupBy(*group).agg(F.count(F.lit(1)).alias("kinds"))
    # sum (o - e)^2 / e over all kinds = sum o^2 / e - n, so kinds that the branch lacks need no rows.
    followed = kinds.join(shares, [*group, "kind"]).groupBy(*group, "child").agg((F.sum(F.col("n") * F.col("n") / F.col("share")) / F.sum("n") - F.sum("n")).alias("shape"))
    labelled = own.join(whole, group)
    parts = [("bad", "all_bad"), ("good", "all_good"), (F.col("n") - F.col("bad") - F.col("good"), F.col("all") - F.col("all_bad") - F.col("all_good"))]
    parts = [(F.col(o) if isinstance(o, str) else o, F.col(m) if isinstance(m, str) else m) for o, m in parts]
    chi = sum((F.when(m > 0, o * o * F.col("all") / m).otherwise(0.0) for o, m in parts), F.lit(0.0)) / F.col("n") - F.col("n")
    used = sum(((m > 0).cast("int") for _, m in parts), F.lit(0)) - 1
    labelled = labelled.where(_within(chi, used)).select(*group, "child")
    tested = followed.join(hinted(work.keep(number)), group).where(_within(F.col("shape"), F.col("kinds") - 1))
    alike = work.keep(tested.join(labelled, [*group, "child"], "left_semi").select(*group, "child"))
    names = alike.groupBy("host", "node", "outcome").agg(F.min("child").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1")
    merged = alike.join(hinted(work.keep(names)), ["host", "node", "outcome"]).select("host", "node", "child", F.concat(F.lit("{"), "least", F.lit("~"), F.when(F.col("outcome") == "unlabelled", "").otherwise(F.col("outcome")), F.lit("}")).alias("general"))

    changes = work.sized(rare.unionByName(merged))
    segs = F.when(F.col("general").isNull(), F.col("segs")).otherwise(F.transform("segs", lambda s, i: F.when(i == level, F.col("general")).otherwise(s)))
    keyed = tree.withColumn("node", F.when(deep, node)).withColumn("child", F.when(deep, F.try_element_at("segs", F.lit(level + 1))))
    return work.keep(keyed.join(changes, ["host", "node", "child"], "left").select("key", "host", segs.alias("segs"), "n", "bad", "good"))


def templates(work: Workspace, urls: DataFrame) -> DataFrame:
    """(host, key, template, purity, labelled): the template of each kind of path (key) of a host, with its smoothed purity.

    ``urls``: host, path and bad (boolean or null).  Purity is the share of unwanted URLs among a template's labelled ones, drawn towards that of the
    node above by SMOOTHING further labels, from the host and all hosts down.
    """
    seen = urls.select("host", segments(F.col("path")).alias("segs"), "bad")
    key = F.concat_ws("/", "segs").alias("key")
    count = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("bad")).alias("bad"), F.count_if(~F.col("bad")).alias("good")]
    tree = work.keep(seen.groupBy("host", "segs").agg(*count).select(key, "host", "segs", "n", "bad", "good"))
    for level in range(DEPTH + 1):
        if tree.where(F.size("segs") > level).isEmpty():
            break
        tree = _generalised(work, tree, level)
    total = tree.agg(F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("labelled")).first()
    prior = ((total["bad"] or 0) + 1.0) / ((total["labelled"] or 0) + 2.0)

    named = tree.select("host", "key", F.concat_ws("/", "segs").alias("template"), F.size("segs").alias("depth"), "segs", "n", "bad", "good")
    kinds = work.keep(named.groupBy("host", "template", "depth", "segs").agg(*_sums()))
    above = kinds.select("host", "template", "depth", "bad", "good", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("at"), "segs").withColumn("node", F.concat_ws("/", F.slice("segs", 1, F.col("at"))))
    sums = above.groupBy("host", "at", "node").agg(F.sum("bad").alias("bad_here"), F.sum(F.col("bad") + F.col("good")).alias("labelled_here"))
    way = above.drop("bad", "good").join(sums, ["host", "at", "node"]).groupBy("host", "template", "depth").agg(F.sort_array(F.collect_list(F.struct("at", "bad_here", "labelled_here"))).alias("way"))
    purity = F.aggregate("way", F.lit(prior), lambda p, x: (x["bad_here"] + SMOOTHING * p) / (x["labelled_here"] + SMOOTHING))
    own = F.element_at("way", -1)["labelled_here"]
    judged = way.select("host", "template", "depth", purity.alias("purity"), own.alias("labelled"))
    return named.select("host", "key", "template", "depth").join(judged, ["host", "template", "depth"]).select("host", "key", "template", "purity", "labelled")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every URL: the longest fitting rule's verdict, else the template's.

    1. URLs are labelled by ``label_col`` (boolean: unwanted) where it is given and not null, else by the rule that fits, if any.
    2. Each host's paths form a tree of segments.  Numbers, hexadecimal names and very long names are wildcards from the start, which leaves few
       kinds of paths, counted by a shuffle; from then on only these kinds move.
    3. From the root down, children with a small share of a node with many become a wildcard; the others are compared with their
       siblings of the same outcome (mostly unwanted, wanted, unlabelled, or mixed) by chi-square tests over what follows and over the labels, and those alike are merged.
       A branch that a rule labels as a whole is thus never merged with one of which nothing is known.
    4. A template is rejected (verdict ``block``) if it has EVIDENCE labels of its own and a smoothed purity of PURITY or more.

    Rules are a list that every task holds.  A null URL, or one without ://, has empty host and path, which no rule fits.  Repeated rows are judged each.
    Empty table: no rows.  Other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    given = F.col(label_col) if label_col else F.lit(None).cast("boolean")
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), given.alias("given"))
    ruled = parsed.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    urls = ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.action").alias("action"), F.coalesce("given", F.col("fit.action") == "block").alias("bad"))
    with Workspace(pages.sparkSession, "url-filter") as work:
        kinds = work.sized(templates(work, urls))
        keyed = urls.withColumn("key", F.concat_ws("/", segments(F.col("path"))))
        found = keyed.join(kinds, ["host", "key"])
        rejected = (F.col("labelled") >= EVIDENCE) & (F.col("purity") >= PURITY)
        verdict = F.coalesce("action", F.when(rejected, "block").otherwise("allow"))
        return cut(found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat(F.lit("/"), "template").alias("template"), F.round("purity", 6).alias("purity")))
