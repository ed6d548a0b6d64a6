"""Curriculum documents into courses (SRC-26, SRC-27, JOI-19, AGG-47): a state machine over each document's lines.

Pages arrive as rows (document, page_no, text); extracting text from files is outside.  What a line means depends on all
lines before it: whether a course list has begun, was ended by a study plan, or whose topics are being read.  Each line is one
event of a small :class:`Machine`.  Pages are read apart: a page is a map from the state in which it begins to that in which it ends.
Only these maps (a few numbers a page) are walked in order, document by document; then each page's lines get their
states.  So a document of very many pages is not one task's text, and a block may wrap over any number of pages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Machine:
    """``page_events`` (conditions on ``text`` and ``page_no``) come before a page's lines, all that hold, in order; a line is the first of ``line_events``
    (conditions on the line and the next one) that holds.  ``moves`` gives the state after an event, in which others change
    nothing; the moves in ``opens`` begin a new block.
    """

    states: tuple[str, ...]
    page_events: dict[str, Column]
    line_events: dict[str, Callable[[Column, Column], Column]]
    moves: dict[tuple[str, str], str]
    opens: frozenset[tuple[str, str]]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        events = [None, *self.page_events, *self.line_events]
        to = np.array([[self.states.index(self.moves.get((s, e), s)) for e in events] for s in self.states], np.int32)
        opened = np.array([[(s, e) in self.opens for e in events] for s in self.states], np.int64)
        return to, opened


def _maps(machine: Machine):
    to, opened = machine.tables()
    n = len(machine.states)

    @F.pandas_udf("array<long>")
    def run(events: pd.Series) -> pd.Series:
        out = []
        for page in events:
            at, count = np.arange(n), np.zeros(n, np.int64)
            for e in page.tolist():
                count += opened[at, e]
                at = to[at, e]
            out.append(np.concatenate([at, count]))
        return pd.Series(out)

    return run


def _starts(n: int):
    """Over pages sorted by document and page: the state and block in which each begins."""

    def run(batches):
        now, state, block, last = object(), 0, 0, None
        for b in batches:
            docs, numbers, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for doc, page, ends in zip(docs, numbers, b.column(2).to_pylist()):
                if doc != now:
                    now, state, block = doc, 0, 0
                elif page == last:
                    raise ValueError(f"document {doc!r} has page {page} twice")
                last = page
                rows.append((state, block))
                state, block = ends[state], block + ends[n + state]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], ["document", "page_no", "_state", "_block"])

    return run


def _walk(machine: Machine):
    to, opened = machine.tables()
    names, skip = machine.states, len(machine.page_events)

    @F.pandas_udf("array<struct<state: string, block: long, opened: boolean>>")
    def run(events: pd.Series, state: pd.Series, block: pd.Series) -> pd.Series:
        out = []
        for page, s, k in zip(events, state, block):
            rows = []
            for e in page.tolist():
                new = bool(opened[s, e])
                k += new
                s = to[s, e]
                rows.append({"state": names[s], "block": int(k), "opened": new})
            out.append(rows[skip:])
        return pd.Series(out)

    return run


def read_lines(pages: DataFrame, machine: Machine) -> DataFrame:
    """(document, page_no, n, line, state, block, opened): every line with the state after it, the number of its block, and whether it opened it.

    A null text is one empty line.  A null document is one of its own; a page number that a document has twice is an error.
    """
    names = [None, *machine.page_events, *machine.line_events]
    first = F.array(*[F.when(c, F.lit(names.index(e))).otherwise(F.lit(0)) for e, c in machine.page_events.items()])
    p = pages.select(F.col("document").cast("string").alias("document"), F.col("page_no").cast("long").alias("page_no"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), first.alias("first"))
    following = F.coalesce(F.lead(F.get("lines", F.lit(0))).over(Window.partitionBy("document").orderBy("page_no")), F.lit(""))
    p = p.withColumn("next", F.concat(F.slice("lines", F.lit(2), F.size("lines")), F.array(following)))

    def event(line: Column, after: Column) -> Column:
        found = F.lit(0)
        for name in reversed(list(machine.line_events)):
            found = F.when(machine.line_events[name](line, after), F.lit(names.index(name))).otherwise(found)
        return found

    p = p.withColumn("events", F.concat("first", F.zip_with("lines", "next", event))).drop("next", "first")
    ends = p.select("document", "page_no", _maps(machine)("events").alias("ends"))
    starts = ends.repartition("document").sortWithinPartitions("document", "page_no").mapInArrow(_starts(len(machine.states)), "document string, page_no long, _state int, _block long")
    s = starts.withColumnsRenamed({"document": "_d", "page_no": "_p"})
    joined = p.join(s, p["document"].eqNullSafe(s["_d"]) & p["page_no"].eqNullSafe(s["_p"]))
    walked = joined.select("document", "page_no", "lines", _walk(machine)("events", "_state", "_block").alias("w"))
    return walked.select("document", "page_no", F.posexplode(F.arrays_zip("lines", "w")).alias("n", "x")).select("document", "page_no", "n", F.col("x.lines").alias("line"), "x.w.state", "x.w.block", "x.w.opened")


def blocks(lines: DataFrame, state: str, title: Column, text: Column) -> DataFrame:
    """(document, title_key, topics): the lines in ``state`` of each block, joined, under the title on the line that opened it.

    Of blocks with equal titles the last one that has a text counts; blocks without title or text are none.
    """
    part = F.when(F.col("state") == state, F.struct("page_no", "n", text.alias("t")))
    own = lines.where(F.col("opened") | (F.col("state") == state)).groupBy("document", "block").agg(F.max(F.when(F.col("opened"), title)).alias("title"), F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.trim(F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["t"]), " "), r"(?U)\s+", " "))
    found = own.select("document", "block", T.normal(F.col("title")).alias("title_key"), joined.alias("topics")).where("title_key <> '' AND topics <> ''")
    return found.groupBy("document", "title_key").agg(F.max_by("topics", "block").alias("topics"))


# The layouts of the two kinds of documents.
_PROGRAM_ROW = r"(?U)^\s*(?:\d+\s+\d*\s*|\.\s*)?(?:([A-Z]{2,4}\d[\dx]*)\s+)?(.+?)\s+((?:Domain\s+)?(?:Core|Elective)|Maths|GER|EW|SS)\s+(\d+\s*\([\d\-]+\))\s*$"
_PROGRAM_NEAR = r"(?U)\d\s*\(\d-\d\)"
_STUDY_PLAN = r"(?i)(Suggested Semester|Study Plan for)"
_LEADING_ABBREVIATION = r"^[A-Z]{2,6}\s+(?=[^\s&])"
_SCHEME_ROW = r"(?U)^\s*\d+\s+(.+?)\s+(\d+\s*\([\d\+\-]+\))\s+(General Education|Major|IDS[\s\-\w]*)\s*$"
_ELECTIVE_ROW = r"(?U)^\s*(\d+)[\.\)]?\s+([A-Za-z*].+?)\s+([\(\)\d\+\-/]+)\s*$"
_SCHEME_NEAR = r"(?U)^\s*\d+[\.\)]?\s+\D.*\d[\+\-/\d\(\)]*\s*$"
_OUTCOME_HEADER = r"(?U)^\d+\.\s+([A-Za-z].{2,90})$"
_NAME, _INTRODUCTION, _REFERENCES, _OUTCOMES_BEGIN = "Course Name:", "Course Introduction:", "Reference Materials", "By the end of this course"
_SCHEME_PAGE, _ELECTIVES_PAGE, _OUTCOMES_PAGE, _AFTER_PAGE = "SEMESTER-I", "GUIDELINES FOR SPECIALIZATIONS", "COURSE LEARNING OUTCOMES (CLOS):", "CERTIFICATIONS"

COURSE = ["document", "page_no", "n", "program", "code", "title", "credit_hours", "unparsed"]


def _after(line: Column, marker: str) -> Column:
    return F.trim(F.substring_index(line, marker, -1))


def _program_machine(contents_from: int) -> Machine:
    """Course lists of programs, each ended by its study plan; then, from a page on, blocks of name and introduction.

    A name waits for the next introduction; names between the two are passed over.  Only a line that begins with a marker ends an introduction.
    """
    has = F.contains
    inside = ("contents", "untitled", "named", "topics")
    moves = {(s, "program page"): "list" for s in ("before", "list", "plan")} | {(s, "contents page"): "contents" for s in ("before", "list", "plan")}
    moves |= {("list", "plan"): "plan", ("contents", "name"): "named", ("contents", "inner name"): "named", ("contents", "bare name"): "untitled", ("untitled", "text"): "named", ("named", "introduction"): "topics"}
    moves |= {("topics", "name"): "named", ("topics", "bare name"): "untitled", ("topics", "references"): "contents"}
    return Machine(
        ("before", "list", "plan", *inside),
        {"program page": F.col("is_program"), "contents page": (F.col("page_no") >= contents_from) & has(F.col("text"), F.lit(_NAME))},
        {
            "introduction": lambda x, _: has(x, F.lit(_INTRODUCTION)),
            "bare name": lambda x, _: F.startswith(x, F.lit(_NAME)) & (_after(x, _NAME) == ""),
            "name": lambda x, _: F.startswith(x, F.lit(_NAME)),
            "inner name": lambda x, _: has(x, F.lit(_NAME)) & (_after(x, _NAME) != ""),
            "references": lambda x, _: F.startswith(x, F.lit(_REFERENCES)),
            "plan": lambda x, _: x.rlike(_STUDY_PLAN),
            "text": lambda x, _: F.trim(x) != "",
        },
        moves,
        frozenset({("contents", "name"), ("contents", "inner name"), ("untitled", "text"), ("topics", "name")}),
    )


def program_courses(pages: DataFrame, programs: DataFrame, contents_from: int = 50) -> tuple[DataFrame, DataFrame]:
    """SRC-26: (courses, topics) of documents that list several programs, ``programs`` telling their first pages (document, program, page_no).

    courses: document, page_no, n, program, code (null where a row has none), title (without the abbreviation of a
    prerequisite before it), credit_hours, unparsed: the line where it looks like a row but cannot be read.  Rows after
    the words of a study plan restate the list and are passed over.  topics: document, title_key, topics.
    """
    starts = programs.select(F.col("document").alias("_d"), F.col("page_no").alias("_p"), "program")
    p = pages.select("document", "page_no", "text").join(F.broadcast(starts) if starts.count() <= 100_000 else starts, F.col("document").eqNullSafe(F.col("_d")) & (F.col("page_no") == F.col("_p")), "left").drop("_d", "_p")
    marked = p.withColumn("is_program", F.col("program").isNotNull())
    of_page = marked.select(F.col("document").alias("_d"), F.col("page_no").alias("_p"), F.last("program", ignorenulls=True).over(Window.partitionBy("document").orderBy("page_no")).alias("program"))
    lines = read_lines(marked, _program_machine(contents_from))
    got = lines.where("state = 'list'").join(of_page, F.col("document").eqNullSafe(F.col("_d")) & F.col("page_no").eqNullSafe(F.col("_p"))).drop("_d", "_p")
    part = lambda k: F.nullif(F.regexp_extract("line", _PROGRAM_ROW, k), F.lit(""))
    raw = part(2)
    title = F.when(raw.rlike(_LEADING_ABBREVIATION) & (F.upper(raw) != raw), F.trim(F.regexp_replace(raw, _LEADING_ABBREVIATION, ""))).otherwise(F.trim(raw))
    rows = got.select("document", "page_no", "n", "program", part(1).alias("code"), title.alias("title"), F.trim(part(4)).alias("credit_hours"), F.when(raw.isNull() & F.col("line").rlike(_PROGRAM_NEAR), F.trim("line")).alias("unparsed"))
    line = F.col("line")
    name = F.when(F.contains(line, F.lit(_NAME)), _after(line, _NAME)).otherwise(F.trim(line))
    text = F.when(F.contains(line, F.lit(_INTRODUCTION)), _after(line, _INTRODUCTION)).otherwise(line)
    return rows.where("title IS NOT NULL OR unparsed IS NOT NULL"), blocks(lines, "topics", name, text)


def _section_machine() -> Machine:
    """A scheme of studies, pools of electives and learning outcomes, each begun by a page; outcomes have a header a course."""
    moves = {("before", "scheme page"): "scheme", ("before", "electives page"): "electives", ("scheme", "electives page"): "electives"}
    moves |= {(s, "outcomes page"): "outcomes" for s in ("before", "scheme", "electives")} | {(s, "after page"): "after" for s in ("outcomes", "topics")}
    return Machine(
        ("before", "scheme", "electives", "outcomes", "topics", "after"),
        {name: F.contains(F.col("text"), F.lit(marker)) for name, marker in (("scheme page", _SCHEME_PAGE), ("electives page", _ELECTIVES_PAGE), ("outcomes page", _OUTCOMES_PAGE), ("after page", _AFTER_PAGE))},
        {"header": lambda x, after: F.trim(x).rlike(_OUTCOME_HEADER) & F.startswith(F.trim(after), F.lit(_OUTCOMES_BEGIN))},
        moves | {("outcomes", "header"): "topics", ("topics", "header"): "topics"},
        frozenset({("outcomes", "header"), ("topics", "header")}),
    )


def scheme_courses(pages: DataFrame, program: str) -> tuple[DataFrame, DataFrame]:
    """SRC-27: (courses, topics) of documents with a scheme of studies, pools of electives and learning outcomes, in :func:`program_courses`' columns.

    Rows have no codes.  Of equal titles in a document the first counts: an elective may be in several pools.
    """
    lines = read_lines(pages, _section_machine())
    listed = lines.where("state IN ('scheme', 'electives')")
    part = lambda p, k: F.nullif(F.regexp_extract("line", p, k), F.lit(""))
    scheme = F.col("state") == "scheme"
    title = F.coalesce(F.when(scheme, part(_SCHEME_ROW, 1)), part(_ELECTIVE_ROW, 2))
    credit = F.coalesce(F.when(scheme, part(_SCHEME_ROW, 2)), part(_ELECTIVE_ROW, 3))
    near = F.col("line").rlike(_SCHEME_NEAR) & ~F.contains("line", F.lit("Total Credits"))
    got = listed.select("document", "page_no", "n", F.lit(program).alias("program"), F.lit(None).cast("string").alias("code"), F.trim(title).alias("title"), F.trim(credit).alias("credit_hours"), F.when(title.isNull() & near, F.trim("line")).alias("unparsed"))
    w = Window.partitionBy("document", T.normal(F.col("title"))).orderBy("page_no", "n")
    once = got.where("title IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    rows = once.unionByName(got.where("title IS NULL AND unparsed IS NOT NULL"))
    name = F.regexp_extract(F.trim("line"), _OUTCOME_HEADER, 1)
    # the header's own line is no topic
    body = lines.withColumn("state", F.when(F.col("opened"), "header").otherwise(F.col("state")))
    return rows, blocks(body, "topics", name, F.col("line"))


def with_topics(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """JOI-19: courses (no unparsed lines) with their topics by document and normalised title, null without."""
    c = rows.where("title IS NOT NULL").drop("unparsed").withColumn("title_key", T.normal(F.col("title")))
    return c.join(topics.withColumnRenamed("document", "_d").withColumnRenamed("title_key", "_k"), F.col("document").eqNullSafe(F.col("_d")) & (F.col("title_key") == F.col("_k")), "left").drop("_d", "_k", "title_key")


def coverage(rows: DataFrame, courses: DataFrame, topics: DataFrame) -> DataFrame:
    """ORC-08: (document, program, courses, matched_topics, unmatched_topics, unparsed_lines, topic_blocks); a document's totals have a null program."""
    c = courses.groupingSets([["document", "program"], ["document"]], "document", "program").agg(F.count("*").alias("courses"), F.count("topics").alias("matched_topics"), F.grouping("program").alias("_whole"))
    u = rows.where("unparsed IS NOT NULL").groupingSets([["document", "program"], ["document"]], "document", "program").agg(F.count("*").alias("unparsed_lines"), F.grouping("program").alias("_whole"))
    both = c.join(u, c["document"].eqNullSafe(u["document"]) & c["program"].eqNullSafe(u["program"]) & (c["_whole"] == u["_whole"]), "full")
    pick = both.select(F.coalesce(c["document"], u["document"]).alias("document"), F.coalesce(c["program"], u["program"]).alias("program"), F.coalesce(c["_whole"], u["_whole"]).alias("_whole"), F.coalesce("courses", F.lit(0)).alias("courses"), F.coalesce("matched_topics", F.lit(0)).alias("matched_topics"), F.coalesce("unparsed_lines", F.lit(0)).alias("unparsed_lines"))
    t = topics.groupBy(F.col("document").alias("_d")).agg(F.count("*").alias("n"))
    j = pick.join(t, F.col("document").eqNullSafe(F.col("_d")), "left")
    return j.select("document", "program", "courses", "matched_topics", (F.col("courses") - F.col("matched_topics")).alias("unmatched_topics"), "unparsed_lines", F.when(F.col("_whole") == 1, F.coalesce("n", F.lit(0))).alias("topic_blocks"))


def course_skills(courses: DataFrame, vocabulary: list[tuple[str, list[str]]]) -> DataFrame:
    """AGG-47: (course_id, skill, match_source): title and topics are searched apart, so a skill in both has two rows."""
    one = lambda c: courses.select("course_id", F.explode(T.matched(F.lower(F.coalesce(c, F.lit(""))), vocabulary)).alias("skill"), F.lit(c).alias("match_source"))
    return one("title").unionByName(one("topics"))


def mapping_report(courses: DataFrame, found: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """AGG-47: (totals, skills of most courses, courses without any skill)."""
    own = found.select("course_id").distinct()
    matched = own.agg(F.count("*").alias("matched_courses"))
    totals = courses.agg(F.count("*").alias("courses")).crossJoin(matched).crossJoin(found.agg(F.countDistinct("skill").alias("skills"), F.count("*").alias("rows")))
    ranked = found.groupBy("skill").agg(F.countDistinct("course_id").alias("courses")).orderBy(F.desc("courses"), "skill").limit(top)
    return totals.withColumn("unmatched_courses", F.col("courses") - F.col("matched_courses")), ranked, courses.join(own, "course_id", "left_anti")
