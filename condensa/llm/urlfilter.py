"""URL filter: host and path rules, then path-template trees per host. DataFrame functions only.

Rules come first: the longest rule whose host is the URL's host or a parent domain of it and
whose path starts the URL's path. Pages that a rule decided are the labels of the rest:

1. Segments that are numbers, hex strings or dates are wildcards from the start (``{n}``,
   ``{x}``, ``{d}``). The tree grows from the host down until every path has ended or is
   the only one left below its node; segments that all paths below a node share are taken at once, so there are as many levels
   as a path has branchings or ends on its way, not as it has segments. Below a node, literal branches that are some of many rare ones become one wildcard (``*``).
2. A branch's profile counts its pages by what is below: whether and how far the path goes on, and the form of
   the next segment. Branches of a node that have the same form, the same commonest form below and the same majority of
   labels are one cluster, but for those whose profile a chi-square test of homogeneity tells from the other
   members'. Branches without labels are told by their profile alone: they go to the labelled cluster
   that is nearest to it if the test finds no difference and they have at least ``least`` pages, else to their own: of fewer pages
   the test can't tell a difference. All members of a cluster are one branch of the tree; the next level
   grows below it.
3. A template (host and clusters down to the path's end) is rejected if the smoothed
   share of blocked pages among its labelled ones reaches ``reject_at``; the prior counts as
   ``prior_allow`` allowed and ``prior_block`` blocked pages, so a template without labels is allowed.

Pages are counted by host and shape of path before any shuffle, and the tree is made of these
counts by aggregates and plain joins, so a host with a third of all pages costs no task more than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.llm.shared import Scratch

#: (rule, verdict); a rule is a host, a slash and a path prefix.
RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FORMS = ("end", "{n}", "{x}", "{d}", "literal")
#: 0.999 quantiles of chi-square by the number of classes, for two profiles.
_CHI2 = {2: 10.828, 5: 18.467}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract cuts them; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits. The rules are a short configured list."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        of, slash, start = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    """A segment's wildcard if it is variable by its form, else itself."""
    stem = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1)
    tail = F.lower(F.regexp_extract(segment, r"^.*?(\.[A-Za-z]{1,5})?$", 1))
    kind = (
        F.when(stem.rlike(r"^\d{4}-\d{2}-\d{2}$"), "{d}").when(stem.rlike(r"^\d+$"), "{n}")
        .when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), "{x}")
    )
    return F.when(kind.isNotNull(), F.concat(kind, tail)).otherwise(segment)


def _told(mine: Column, n: Column, theirs: Column, m: Column) -> Column:
    """Chi-square of homogeneity of two profiles of n and m pages, as a share of its 0.999 quantile: the largest of
    those of its three parts; zero if one has no pages."""
    terms = F.zip_with(mine, theirs, lambda a, b: F.when(a + b > 0, (a * m - b * n) * (a * m - b * n) / (a + b)).otherwise(0.0))
    total = lambda t, first, k: F.aggregate(F.slice(t, first, k), F.lit(0.0), lambda s, x: s + x)
    parts = F.transform(F.array(terms), lambda t: F.greatest(total(t, 1, 2) / _CHI2[2], total(t, 3, 2) / _CHI2[2], total(t, 5, 5) / _CHI2[5]))
    return F.when((n > 0) & (m > 0), F.get(parts, F.lit(0)) / (n * m)).otherwise(0.0)


def _form(segment: Column) -> Column:
    """The wildcard that a segment is, ``end`` for an empty one, else ``literal``."""
    return F.when(segment == "", "end").when(segment.startswith("{"), F.substring(segment, 1, 3)).otherwise("literal")


#: A branch's profile: pages whose path goes on or doesn't, goes on further or doesn't, and by the form of the next segment.
_PARTS = [f"p{k}" for k in range(4 + len(_FORMS))]


def _level(paths: DataFrame, many: int, rare: float, least: int) -> DataFrame:
    """One level of the tree: paths (host, shape, blocked, allowed, n, node, left) with the node and what is left of them below it."""
    columns = paths.columns
    pages = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    # what the least and the greatest path below a node share, all share
    ends = [F.split(F.regexp_replace(f(F.concat("left", F.lit("/"))), "/$", ""), "/") for f in (F.min, F.max)]
    nodes = paths.groupBy("node").agg(F.count(F.lit(1)).alias("paths"), ends[0].alias("low"), ends[1].alias("high"), (F.sum(F.col("blocked") + F.col("allowed")) > 0).alias("told"))
    same = F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.slice("low", 1, F.array_position(F.array_append(same, False), False).cast("int") - 1)
    # a branch without others is a cluster of its own, named like one if it has labels
    names = F.when(F.col("told"), F.transform("steps", lambda x: F.concat(F.lit("<"), x, F.lit(">")))).otherwise(F.col("steps"))
    nodes = nodes.withColumn("steps", F.when(F.col("paths") > 1, shared).otherwise(F.array().cast("array<string>")))
    nodes = nodes.select("node", "paths", F.array_join("steps", "/").alias("shared"), F.array_join(names, "/").alias("names"))
    going = paths.join(nodes, "node").withColumns({
        "node": F.when(F.col("shared") == "", F.col("node")).otherwise(F.concat_ws("/", "node", "names")),
        "left": F.when(F.col("shared") == "", F.col("left")).otherwise(F.expr("substr(`left`, length(shared) + 2)")),
    })
    ended = going.where(F.col("left") == "").select(*columns)
    cut = F.locate("/", F.col("left"))
    whole = (F.col("paths") == 1) | (cut == 0)
    going = going.where(F.col("left") != "").withColumns({
        "branch": F.when(whole, F.col("left")).otherwise(F.expr("left(`left`, locate('/', `left`) - 1)")),
        "rest": F.when(whole, "").otherwise(F.expr("substr(`left`, locate('/', `left`) + 1)")),
    }).drop("paths", "left", "shared", "names")
    goes, deep = F.col("rest") != "", F.locate("/", F.col("rest")) > 0
    tests = [goes, ~goes, deep, ~deep, *[_form(F.col("rest")) == f for f in _FORMS]]
    tree = going.groupBy("node", "branch").agg(*[F.sum(c).alias(c) for c in ("blocked", "allowed", "n")], *[pages(t).cast("double").alias(c) for c, t in zip(_PARTS, tests, strict=True)])
    tree = tree.withColumn("form", _form(F.col("branch")))
    literal = F.col("form") == "literal"
    width = tree.groupBy("node").agg(F.count_if(literal).alias("literals"), F.sum(F.when(literal, F.col("n")).otherwise(0)).alias("pages"))
    # a rare branch has at most ``rare`` times the mean pages of its node's literal ones
    seldom = literal & (F.col("literals") > many) & (F.col("n") * F.col("literals") <= F.col("pages") * rare)
    tree = tree.join(width, "node").withColumn("name", F.when(seldom, "*").otherwise(F.col("branch")))

    state = F.when((F.col("blocked") > 0) & (F.col("blocked") >= F.col("allowed")), "blocked").when(F.col("allowed") > 0, "allowed").otherwise("unlabelled")
    common = F.array_max(F.array(*[F.struct(F.col(c).alias("n"), F.lit(k).alias("k")) for k, c in enumerate(_PARTS[4:])]))["k"]
    named = tree.groupBy("node", "form", "name").agg(*[F.sum(c).alias(c) for c in ("blocked", "allowed", "n", *_PARTS)]).withColumns({"state": state, "common": common})
    # one row a node, form and commonest form below, with a cluster for each state
    def cluster(s: str) -> Column:
        one = lambda c: F.when(F.col("state") == s, c)
        sums = F.array(*[F.coalesce(F.sum(one(F.col(c))), F.lit(0.0)) for c in _PARTS])
        return F.struct(F.count(one(F.lit(1))).alias("members"), F.max(one(F.struct("n", "name")))["name"].alias("head"), F.coalesce(F.sum(one(F.col("n"))), F.lit(0)).alias("n"), sums.alias("parts")).alias(s)

    states = ("blocked", "allowed", "unlabelled")
    clusters = named.groupBy("node", "form", "common").agg(*[cluster(s) for s in states])
    pairs = named.select("node", "form", "name", "n", "state", "common", F.array(*_PARTS).alias("mine")).join(clusters, ["node", "form", "common"])
    labelled = F.col("state") != "unlabelled"
    own = F.when(F.col("state") == "blocked", F.col("blocked")).when(F.col("state") == "allowed", F.col("allowed")).otherwise(F.col("unlabelled"))
    pairs = pairs.withColumn("own", own)
    n = F.col("n").cast("double")
    others = F.zip_with("own.parts", "mine", lambda a, b: a - b)
    apart = {f"to_{s}": _told(F.col("mine"), n, F.col(f"{s}.parts"), F.col(f"{s}.n").cast("double")) for s in states[:2]}
    # the test of a branch against its own cluster leaves the branch itself out
    pairs = pairs.withColumns(apart | {"alone": _told(F.col("mine"), n, others, F.col("own.n") - n) > 1})
    near = lambda s: F.when((F.col(f"{s}.members") > 0) & (F.col(f"to_{s}") <= 1), F.struct((-F.col(f"to_{s}")).alias("near"), F.col(f"{s}.n").alias("n"), F.col(f"{s}.head").alias("head")))
    pairs = pairs.withColumn("to", F.when(~labelled & (F.col("n") >= least), F.greatest(near("blocked"), near("allowed")))["head"])
    # a head that stands alone itself still names its cluster
    name = F.when(F.col("to").isNotNull(), F.concat(F.lit("<"), "to", F.lit(">"))).when((F.col("own.members") == 1) & ~labelled | F.col("alone"), F.col("name")).otherwise(
        F.concat(F.lit("<"), F.col("own.head"), F.lit(">")))
    children = pairs.select("node", "name", F.concat("node", F.lit("/"), name).alias("child"))
    below = tree.select("node", "branch", "name").join(children, ["node", "name"]).select("node", "branch", "child")
    return going.join(below, ["node", "branch"]).select("host", "shape", "blocked", "allowed", "n", F.col("child").alias("node"), F.col("rest").alias("left")).unionByName(ended)


def judge(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, many: int = 50, rare: float = 3, least: int = 5,
    prior_allow: float = 2.0, prior_block: float = 1.0, reject_at: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity and labelled of each row.

    ``many``: a node with more literal branches than this
    turns those of at most ``rare`` times their mean pages into one wildcard; ``least``: pages that a branch without labels needs
    to join a labelled cluster (a chi-square test asks for five expected counts); ``labelled``: the template's pages that a rule decided.
    A null URL or one without ``://`` has an empty host and path and falls under no rule; its template is that of the empty
    host, without labels, so it is allowed. Ids pass through; repeated rows each count and each
    give a row; other columns are ignored; an empty table gives no rows. URLs of any length are read whole.
    """
    scratch = Scratch(pages.sparkSession, "url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    steps = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _shape)
    rows = rows.withColumns({"rule": rule, "said": said, "shape": F.array_join(steps, "/")})
    # one row a host and shape of path, after map-side sums
    paths = rows.groupBy("host", "shape").agg(
        F.count_if(F.col("said") == "block").alias("blocked"), F.count_if(F.col("said") == "allow").alias("allowed"), F.count(F.lit(1)).alias("n"),
    )
    going = scratch.staged(paths.withColumns({"node": F.col("host"), "left": F.col("shape")}), "paths")
    while not going.where(F.col("left") != "").isEmpty():
        going = scratch.staged(_level(going.where(F.col("left") != ""), many, rare, least), "level")
    # one scan of all levels: a path is in the level where it ended
    paths = pages.sparkSession.read.schema(going.schema).parquet(*scratch.paths).where(F.col("left") == "").drop("left")
    purity = (F.sum("blocked") + prior_block) / (F.sum("blocked") + F.sum("allowed") + prior_block + prior_allow)
    templates = scratch.staged(paths.groupBy("node").agg(purity.alias("purity"), F.sum(F.col("blocked") + F.col("allowed")).alias("labelled")), "templates")
    verdicts = paths.join(templates, "node").select("host", "shape", F.col("node").alias("template"), "purity", "labelled")
    verdicts = scratch.last(verdicts)
    method = F.when(F.coalesce("purity", F.lit(0.0)) >= reject_at, "block").otherwise("allow")
    return rows.join(verdicts, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", "purity", "labelled"
    )
