"""Queries on curriculum documents, which are rendered from the tables: a document a brand, its parts as courses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import curriculum as R
from ..sources import lenses as L

#: Where the pages of a document's sections begin; lines a page, in lists and in the contents.
LIST, PLAN, NEXT, CONTENTS, LONG, SHORT = 1_000, 1_000_000, 2_000_000, 4_000_000, 40, 7


def _parts(s, d) -> DataFrame:
    """(document, r, title, k, type, size): parts numbered inside their brand; titles are unique."""
    r = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return L.read(s, d, "part").select(F.col("p_brand").alias("document"), r.cast("long").alias("r"), F.concat(F.initcap("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("title"), F.col("p_partkey").alias("k"), F.lower("p_type").alias("type"), F.col("p_size").alias("size"))


def _paged(lines: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("at", "line")))
    return lines.groupBy("document", "page_no").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))


def program_pages(s, d) -> tuple[DataFrame, DataFrame]:
    """Documents of two programs: lists, study plans that restate them, and contents whose blocks run over pages of seven lines."""
    p = _parts(s, d)
    i, q, t = F.col("r") % 5, F.col("r") % 2, F.col("title")
    number = F.concat(F.col("r").cast("string"), F.lit(" 1 "))
    row = (
        F.when(i == 0, F.concat(number, F.lit("CS1xx "), t, F.lit(" Core 3 (3-0)"))).when(i == 1, F.concat(F.lit(". "), t, F.lit(" Elective 3 (2-3)"))).when(i == 2, F.concat(number, F.lit("MT2xx PF "), t, F.lit(" Maths 3 (3-0)")))
        .when(i == 3, F.concat(t, F.lit(" 3 (3-0) and more"))).otherwise(F.concat(number, F.lit("SE3xx "), t, F.lit(" Domain Core 4 (3-3)")))
    )
    base = F.when(q == 0, LIST).otherwise(NEXT)
    lists = p.select("document", (base + F.floor(F.col("r") / LONG)).alias("page_no"), F.col("r").alias("at"), row.alias("line"))
    plans = p.select("document", (base + PLAN + F.floor(F.col("r") / LONG)).alias("page_no"), F.col("r").alias("at"), row.alias("line"))
    heads = p.select("document").distinct()
    fixed = [(LIST, -1, "Curriculum Model of Program 0"), (NEXT, -1, "Curriculum Model of Program 1"), (LIST + PLAN, -1, "Suggested Semester Plan"), (NEXT + PLAN, -1, "A Study Plan for Program 1"), (1, 0, "Course Name: not yet\nCourse Introduction: nor this"), (CONTENTS, -1, "Course Contents")]
    titles = heads.select("document", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("page_no"), F.lit(b).cast("long").alias("at"), F.lit(c).alias("line")) for a, b, c in fixed])).alias("x")).select("document", "x.*")
    block = F.array(
        F.concat(F.lit("Course Name: "), t), F.lit("Credit Hours: 3"), F.concat(F.lit("Course Introduction: begins with "), F.col("type")), F.concat(F.lit("goes on to size "), F.col("size").cast("string"), F.lit("  and")), F.lit("a study plan for Course Name: readers"),
        F.when(F.col("r") % 3 == 0, "Reference Materials").otherwise("ends"), F.when(F.col("r") % 3 == 0, "Some Book Core 3 (3-0)").otherwise("here"),
    )
    each = p.select("document", "r", F.posexplode(block).alias("j", "line")).withColumn("at", F.col("r") * 7 + F.col("j"))
    # five lines of an offset, so that no block begins a page
    contents = each.select("document", (F.lit(CONTENTS) + F.floor((F.col("at") + 5) / SHORT)).alias("page_no"), "at", "line")
    pages = _paged(lists.unionByName(plans).unionByName(titles).unionByName(contents))
    programs = heads.select("document", F.explode(F.array(*[F.struct(F.lit(f"Program {k}").alias("program"), F.lit(at).cast("long").alias("page_no")) for k, at in enumerate((LIST, NEXT))])).alias("x")).select("document", "x.*")
    return pages, programs


def scheme_pages(s, d) -> DataFrame:
    """Documents of a scheme, pools of electives in which the scheme's courses come again, and outcomes."""
    p = _parts(s, d)
    i, t, r = F.col("r") % 4, F.col("title"), F.col("r").cast("string")
    scheme = F.when(i == 0, F.concat(r, F.lit(" "), t, F.lit(" 3 (3+0) Major"))).when(i == 1, F.concat(r, F.lit(". "), t, F.lit(" 3(2+1)"))).when(i == 2, F.concat(r, F.lit(" x "), t, F.lit(" only 7"))).otherwise(F.lit("17 (Total Credits) 18"))
    pool = F.when(i.isin(0, 3), F.concat(r, F.lit(") "), t, F.lit(" 2+1"))).otherwise(F.lit("no row"))
    outcome = F.array(F.concat(r, F.lit(". "), t), F.concat(F.lit("By the end of this course students of "), F.col("type")), F.concat(r, F.lit(". know size "), F.col("size").cast("string")), F.lit("and   more"))
    lists = p.select("document", (LIST + F.floor(F.col("r") / LONG)).alias("page_no"), F.col("r").alias("at"), scheme.alias("line"))
    pools = p.select("document", (NEXT + F.floor(F.col("r") / LONG)).alias("page_no"), F.col("r").alias("at"), pool.alias("line"))
    each = p.select("document", "r", F.posexplode(outcome).alias("j", "line")).withColumn("at", F.col("r") * 4 + F.col("j"))
    outcomes = each.select("document", (F.lit(CONTENTS) + F.floor((F.col("at") + 1) / SHORT)).alias("page_no"), "at", "line")
    fixed = [(LIST, -1, "SEMESTER-I"), (NEXT, -1, "GUIDELINES FOR SPECIALIZATIONS"), (CONTENTS, -1, "COURSE LEARNING OUTCOMES (CLOS):"), (2_000_000_000, 0, "CERTIFICATIONS\n1. Not a course\nBy the end of this course nothing")]
    titles = p.select("document").distinct().select("document", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("page_no"), F.lit(b).cast("long").alias("at"), F.lit(c).alias("line")) for a, b, c in fixed])).alias("x")).select("document", "x.*")
    return _paged(lists.unionByName(pools).unionByName(outcomes).unionByName(titles))


VOCABULARY = [("ring", ["ring"]), ("metal", ["steel", "brushed"]), ("promo", ["promo"]), ("large", ["size 40", "size 41"]), ("first", ["begins with"])]


def _courses(s, d):
    rows, topics = R.program_courses(*program_pages(s, d))
    return rows, R.with_topics(rows, topics), topics


def _program_courses(s, d):
    rows, courses, _ = _courses(s, d)
    unread = rows.where("unparsed IS NOT NULL").select("document", "program", "code", "title", "credit_hours", F.lit(None).cast("string").alias("topics"), "unparsed")
    return courses.select("document", "program", "code", "title", "credit_hours", "topics", F.lit(None).cast("string").alias("unparsed")).unionByName(unread)


def _scheme_courses(s, d):
    rows, topics = R.scheme_courses(scheme_pages(s, d), "BS")
    unread = rows.where("unparsed IS NOT NULL").select("document", "title", "credit_hours", F.lit(None).cast("string").alias("topics"), "unparsed")
    return R.with_topics(rows, topics).select("document", "title", "credit_hours", "topics", F.lit(None).cast("string").alias("unparsed")).unionByName(unread)


def _coverage(s, d):
    return R.coverage(*_courses(s, d))


def _course_skills(s, d):
    return R.course_skills(_courses(s, d)[1].withColumn("course_id", F.concat_ws("/", "document", "title")), VOCABULARY)


QUERIES = {"curriculum_programs": _program_courses, "curriculum_schemes": _scheme_courses, "curriculum_coverage": _coverage, "curriculum_course_skills": _course_skills}

_PARTS = """p AS (SELECT p_brand AS document, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || p_partkey AS title, lower(p_type) AS type, p_size AS size FROM part)"""
_PROGRAMS = f"""{_PARTS}, c AS (SELECT document, 'Program ' || (r % 2) AS program, CASE r % 5 WHEN 0 THEN 'CS1xx' WHEN 2 THEN 'MT2xx' WHEN 4 THEN 'SE3xx' END AS code,
    CASE WHEN r % 5 <> 3 THEN title END AS title, CASE r % 5 WHEN 1 THEN '3 (2-3)' WHEN 3 THEN NULL WHEN 4 THEN '4 (3-3)' ELSE '3 (3-0)' END AS credit_hours,
    CASE WHEN r % 5 <> 3 THEN 'begins with ' || type || ' goes on to size ' || size || ' and a study plan for Course Name: readers' || CASE WHEN r % 3 = 0 THEN '' ELSE ' ends here' END END AS topics,
    CASE WHEN r % 5 = 3 THEN title || ' 3 (3-0) and more' END AS unparsed FROM p)"""

ORACLE_SQL = {
    "curriculum_programs": f"WITH {_PROGRAMS} SELECT * FROM c",
    "curriculum_schemes": f"""WITH {_PARTS} SELECT document, title, CASE r % 4 WHEN 0 THEN '3 (3+0)' WHEN 1 THEN '3(2+1)' ELSE '2+1' END AS credit_hours,
      'By the end of this course students of ' || type || ' ' || r || '. know size ' || size || ' and more' AS topics, NULL AS unparsed FROM p WHERE r % 4 <> 2
      UNION ALL SELECT document, 'x ' || title || ' only', '7', NULL, NULL FROM p WHERE r % 4 = 2""",
    "curriculum_coverage": f"""WITH {_PROGRAMS}, b AS (SELECT document, count(*) AS n FROM p GROUP BY 1)
      SELECT document, program, count(title) AS courses, count(topics) AS matched_topics, count(title) - count(topics) AS unmatched_topics, count(unparsed) AS unparsed_lines,
        CASE WHEN grouping(program) = 1 THEN max(n) END AS topic_blocks FROM c JOIN b USING (document) GROUP BY GROUPING SETS ((document, program), (document))""",
    "curriculum_course_skills": f"""WITH {_PROGRAMS}, t AS (SELECT document || '/' || title AS course_id, lower(title) AS title, lower(topics) AS topics FROM c WHERE title IS NOT NULL),
      m AS (SELECT course_id, unnest([{{'s': 'title', 't': title}}, {{'s': 'topics', 't': topics}}]) AS x FROM t)
      SELECT course_id, skill, x.s AS match_source FROM m, (VALUES ('ring', '\\bring\\b'), ('metal', '\\b(steel|brushed)\\b'), ('promo', '\\bpromo\\b'), ('large', '\\bsize 4[01]\\b'), ('first', '\\bbegins with\\b')) AS v(skill, re) WHERE regexp_matches(x.t, re)""",
}
