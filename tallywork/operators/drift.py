"""Vocabulary drift: depth, n-gram candidates, segments, lift, merge groups (AGG-32..49, FLT-13, FLT-14, JOI-17..22, SET-07..09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cols as C
from ..functions import text as T
from ..session import checkpointed, written
from .market import dimension
from .phrases import gram_excerpts


def substantive_counts(mentions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """AGG-38: distinct substantive skills of each posting that has one."""
    dim = dimension(taxonomy.where(C.substantive(F.col("category"), F.col("requirement_type"))).select("skill"))
    return mentions.join(dim, "skill").groupBy("posting_id").agg(F.countDistinct("skill").alias("n_skills"))


def with_depth(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """JOI-22, ATT-07: postings with their number of skills, 0 where there is none."""
    return postings.join(counts, postings["id"] == counts["posting_id"], "left").select(*postings.columns, F.coalesce("n_skills", F.lit(0)).alias("n_skills"))


def blind_spots(depth: DataFrame) -> DataFrame:
    """FLT-13, FLT-14, JOI-11: postings with one substantive skill at most."""
    return depth.where("n_skills <= 1")


def depth_stats(depth: DataFrame, by: str) -> DataFrame:
    """AGG-32, ATT-08: per group size, median, mean, and percent with at most one and with none."""
    n = F.count("*")
    return depth.groupBy(F.col(by).alias("value")).agg(
        n.alias("n"), F.round(F.percentile("n_skills", 0.5), 2).alias("median"), F.round(F.avg("n_skills"), 2).alias("mean"), F.round(100 * F.count_if(F.col("n_skills") <= 1) / n, 1).alias("pct_le1"), F.round(100 * F.count_if(F.col("n_skills") == 0) / n, 1).alias("pct_0")
    )


def posting_grams(postings: DataFrame, fillers: list[str], most: int = 4, known: DataFrame | None = None, bare: list[str] | None = None) -> DataFrame:
    """STR-07, FLT-15, ATT-11: (id, source, company, domain, gram): clean distinct n-grams, known aliases and single words of ``bare`` left out.

    Grams are cleaned inside the array, before they become rows.
    """
    own = ["id", "source", "company", "domain"]
    t = postings.select(*own, T.tokens(F.coalesce("description", F.lit(""))).alias("tokens"))
    t = t.select(*own, "tokens", T.kept_tokens(F.col("tokens"), fillers).alias("kept"), T.number_tokens(F.col("tokens")).alias("number"))
    g = t.select(*own, F.explode(T.ngrams(F.col("tokens"), F.col("kept"), F.col("number"), most, bare)).alias("gram"))
    return g if known is None else g.join(dimension(known.select(T.normal(F.col("alias")).alias("gram")).distinct()), "gram", "left_anti")


#: Most values of columns that are numbered, so that a set of them is one long.
MOST_BITS = 62
_MANY = {"company": "companies", "source": "sources", "domain": "domains"}


def _numbered(rows: DataFrame, column: str) -> list | None:
    """The values of a column that has few; null if it has many."""
    values = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_BITS + 1).collect()]
    return sorted(values) if len(values) <= MOST_BITS else None


def _bit(column: str, values: list, at: int) -> Column:
    """The bit of a row's value, the first value's being number ``at``; 0 for null."""
    bit = F.lit(0).cast("long")
    for i, v in enumerate(values):
        bit = F.when(F.col(column) == v, F.lit(1 << (at + i)).cast("long")).otherwise(bit)
    return bit


def candidates(grams: DataFrame, least_postings: int = 8, least_companies: int = 3, values_of: DataFrame | None = None) -> DataFrame:
    """AGG-33, AGG-34: grams in enough postings and companies, with the numbers of their sources and domains.

    Companies, sources and domains of which there are at most ``MOST_BITS`` (looked up in ``values_of``, the postings, or the
    grams) are sets of bits in one hash aggregation, so that grams move once.  More companies are counted by grouping by
    company first, which is a second shuffle; more sources or domains by an aggregation of their own.
    """
    return qualified(counted(grams, values_of), grams, least_postings, least_companies)


def counted(grams: DataFrame, values_of: DataFrame | None = None, part: Column | None = None) -> DataFrame:
    """(gram, postings, companies, and sources and domains if these are few) of every gram; see :func:`candidates`.

    With ``part``, a condition on the rows, the same numbers among the rows that hold it follow as ``part_postings`` and so on,
    from the same shuffle.  Columns share a long as far as their values fit into one.
    """
    found = {c: _numbered(values_of if values_of is not None else grams, c) for c in _MANY}
    longs, place, used = [], {}, 0
    for c, values in found.items():
        if values is not None:
            if not longs or used + len(values) > MOST_BITS:
                longs, used = [*longs, F.lit(0).cast("long")], 0
            longs[-1] = longs[-1].bitwiseOR(_bit(c, values, used))
            place[c] = (len(longs) - 1, ((1 << len(values)) - 1) << used)
            used += len(values)
    held = {"": F.lit(True)} | ({} if part is None else {"part_": F.col("_part")})
    rows = grams.select("gram", "company", *[b.alias(f"_{i}") for i, b in enumerate(longs)], *([] if part is None else [F.coalesce(part, F.lit(False)).alias("_part")]))
    bits = [F.bit_or(F.when(on, F.col(f"_{i}")).otherwise(F.lit(0).cast("long"))).alias(f"{p}_{i}") for p, on in held.items() for i in range(len(longs))]
    postings = [(F.count_if(on) if p else F.count("*")).alias(f"{p}postings") for p, on in held.items()]
    if found["company"] is not None:
        n = rows.groupBy("gram").agg(*postings, *bits)
    else:
        each = rows.groupBy("gram", "company").agg(*postings, *bits)
        companies = [F.count_if(F.col("company").isNotNull() & (F.col(f"{p}postings") > 0)).alias(f"{p}companies") for p in held]
        n = each.groupBy("gram").agg(*[F.sum(f"{p}postings").alias(f"{p}postings") for p in held], *companies, *[F.bit_or(f"{p}_{i}").alias(f"{p}_{i}") for p in held for i in range(len(longs))])
    of = lambda p, c: F.bit_count(F.col(f"{p}_{place[c][0]}").bitwiseAND(F.lit(place[c][1]).cast("long"))).cast("long") if c in place else F.col(f"{p}{_MANY[c]}")
    return n.select("gram", *[x for p in held for x in (F.col(f"{p}postings"), *[of(p, c).alias(f"{p}{_MANY[c]}") for c in _MANY if c in place or c == "company"])])


def qualified(by: DataFrame, grams: DataFrame, least_postings: int, least_companies: int, part: Column | None = None) -> DataFrame:
    """The rows of :func:`counted` with enough postings and companies, with the columns that it left out.

    Rows of all grams are counted before they meet the qualified ones, so that no gram moves for each posting that has it.
    """
    by = by.where((F.col("postings") >= least_postings) & (F.col("companies") >= least_companies))
    left = [c for c in ("source", "domain") if _MANY[c] not in by.columns]
    by = written(by) if left else by
    for c in left:
        each = grams.groupBy("gram", c).agg(F.max(F.coalesce(part, F.lit(False)) if part is not None else F.lit(False)).alias("_in")).join(by.select("gram"), "gram", "left_semi")
        part_of = [] if part is None else [F.count_if(F.col(c).isNotNull() & F.col("_in")).alias(f"part_{_MANY[c]}")]
        by = by.join(each.groupBy("gram").agg(F.count(c).alias(_MANY[c]), *part_of), "gram")
    return by.select("gram", *[f"{p}{n}" for p in (("",) if part is None else ("", "part_")) for n in ("postings", *_MANY.values())])


def splits(grams: DataFrame, by: str) -> DataFrame:
    """AGG-33: (gram, value, postings, companies) for each value of source or domain that a gram has."""
    return grams.groupBy("gram", F.col(by).alias("value")).agg(F.count("*").alias("postings"), F.count_distinct("company").alias("companies"))


def details(grams: DataFrame, postings: DataFrame, top: DataFrame) -> DataFrame:
    """AGG-33, WIN-19: ``top`` (gram and more) with by_source and by_domain (map of a value to its postings and companies) and the first excerpts."""
    mine = written(grams.join(F.broadcast(top.select("gram")) if top.count() <= 50_000 else top.select("gram"), "gram", "left_semi").select("id", "source", "company", "domain", "gram"))
    out = top
    for by in ("source", "domain"):
        entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("value", F.lit("")).alias("k"), F.struct("postings", "companies").alias("v")))))
        out = out.join(splits(mine, by).groupBy("gram").agg(entries.alias(f"by_{by}")), "gram")
    return out.join(gram_excerpts(mine, postings, top), "gram", "left")


def segments(grams: DataFrame, by: str, limit: int = 30, least_companies: int = 3, only: DataFrame | None = None) -> DataFrame:
    """AGG-35, SRT-12: per source or domain the grams of most companies; with ``only`` (gram) of those."""
    n = grams.groupBy(by, "gram").agg(F.count_distinct("company").alias("companies"), F.count("*").alias("postings")).where(F.col("companies") >= least_companies)
    n = n if only is None else n.join(only, "gram", "left_semi")
    w = Window.partitionBy(by).orderBy(F.desc("companies"), F.desc("postings"), "gram")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(F.col(by).alias("value"), "gram", "companies", "postings", "place")


def lift(part: DataFrame, whole: DataFrame, part_size: int, whole_size: int) -> DataFrame:
    """AGG-36, JOI-17: share among the part's postings over the share among all."""
    j = part.select("gram", F.col("postings").alias("part_postings")).join(whole.select("gram", F.col("postings").alias("whole_postings")), "gram")
    return j.withColumn("lift", lift_of(F.col("part_postings"), F.col("whole_postings"), part_size, whole_size))


def lift_of(part: Column, whole: Column, part_size: int, whole_size: int) -> Column:
    """The lift of a gram with so many postings of the part and of all."""
    return F.round((part / part_size) / (whole / whole_size), 3)


def split_text(rows: DataFrame, key: str, by: str) -> DataFrame:
    """ATT-12: ``value:n`` of each key, largest first."""
    n = rows.groupBy(key, by).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(by).alias("v"))))
    return n.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["v"], (-x["m"]).cast("string"))), ", ").alias("split"))


def unmatched_titles(postings: DataFrame, least: int = 5) -> DataFrame:
    """AGG-46: titles without a family, by normal form, with three of their spellings."""
    g = postings.where("job_family IS NULL").groupBy(T.normal(F.col("title")).alias("cluster")).agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("title")), 1, 3), " | ").alias("samples"))
    return g.where(F.col("n") >= least)


def taxonomy_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-40, SET-08: skills new in a new category, new, reclassified, or gone between two vocabularies."""
    a, b = before.select("skill", F.col("category").alias("was")), after.select("skill", F.col("category").alias("now"))
    old = dimension(before.select(F.col("category").alias("now")).distinct().withColumn("known", F.lit(True)))
    j = a.join(b, "skill", "full").join(old, "now", "left")
    kind = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull() & F.col("known").isNull(), "new_category").when(F.col("was").isNull(), "new_entry").when(F.col("was") != F.col("now"), "reclassified")
    return j.withColumn("kind", kind).where("kind IS NOT NULL").select("skill", "was", "now", "kind")


def totals_by(rows: DataFrame, by: str, value: str) -> DataFrame:
    """AGG-40, AGG-49: counts of each value by group, with TOTAL rows."""
    return rows.groupingSets([[by, value], [value]], by, value).agg(F.count("*").alias("n"), F.grouping(by).alias("g")).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col(by)).alias("group"), F.col(value).alias("value"), "n")


def merge_groups(phrases: DataFrame, stop: list[str], most_extra: int = 2) -> DataFrame:
    """SET-09, JOI-20: (phrase, canonical): phrases whose word sets contain one another, up to two extra words, joined transitively.

    Pairs meet by the smaller set's rarest word only, so common words do not make all pairs.  The canonical phrase has
    the fewest words, then comes first in the alphabet.
    """
    p = phrases.select("phrase").distinct().withColumn("w", F.array_sort(T.word_set(F.col("phrase"), stop))).where(F.size("w") > 0)
    each = p.select("phrase", "w", F.explode("w").alias("word"))
    freq = each.groupBy("word").agg(F.count("*").alias("f"))
    each = each.join(freq, "word")
    rare = each.groupBy("phrase", "w").agg(F.min_by("word", F.struct("f", "word")).alias("word"))
    big = each.select(F.col("phrase").alias("b"), F.col("w").alias("wb"), "word")
    pair = rare.select(F.col("phrase").alias("a"), F.col("w").alias("wa"), "word").join(big, "word").where((F.col("a") != F.col("b")) & (F.size("wb") - F.size("wa")).between(0, most_extra) & (F.size(F.array_except("wa", "wb")) == 0))
    edges = pair.select("a", "b").unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    order = lambda c: F.struct(F.size(T.word_set(F.col(c), stop)).alias("k"), F.col(c).alias("p"))
    edges = checkpointed(edges)
    now = checkpointed(p.select("phrase", order("phrase").alias("root")))
    while True:  # least label of the neighbours, then of the label's own label
        near = edges.join(now, edges["a"] == now["phrase"]).groupBy(F.col("b").alias("phrase")).agg(F.min("root").alias("n"))
        new = now.join(near, "phrase", "left").select("phrase", F.least("root", F.coalesce("n", "root")).alias("root"))
        up = new.select(F.col("phrase").alias("up"), F.col("root").alias("r2"))
        new = checkpointed(new.join(up, F.col("root.p") == F.col("up"), "left").select("phrase", F.least("root", F.coalesce("r2", "root")).alias("root")))
        if new.join(now.withColumnRenamed("root", "was"), "phrase").where("root <> was").isEmpty():
            return new.select("phrase", F.col("root.p").alias("canonical"))
        now = new


def stratified_sample(rows: DataFrame, by: str, n: int, seed: int = 0) -> DataFrame:
    """WIN-20: ``n`` rows taken in turn from each group, in the order of a hash."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), "id")
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", by).limit(n)


def text_availability(postings: DataFrame, by: str = "source") -> DataFrame:
    """AGG-42, AGG-44, ATT-06: postings with text, with tags only, with neither."""
    b = C.text_bucket(F.col("description"), F.col("skills_raw"))
    n = F.count("*")
    return postings.withColumn("b", b).groupBy(F.col(by).alias("value")).agg(n.alias("n"), *[F.count_if(F.col("b") == k).alias(k.lower()) for k in "ABC"], F.round(100 * F.count_if(F.col("b") != "C") / n, 1).alias("measurable_pct"))


def refill_cost(postings: DataFrame, low: float = 7.0, high: float = 12.0) -> DataFrame:
    """ORC-09: postings without a text and the hours that fetching them again would take."""
    n = F.count_if(C.blank(F.col("description")))
    return postings.agg(n.alias("blank"), F.round(n * low / 3600, 2).alias("hours_low"), F.round(n * high / 3600, 2).alias("hours_high"))
