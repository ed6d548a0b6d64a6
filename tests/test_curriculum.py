"""Curriculum documents: sections, blocks that run over pages, rows that cannot be read."""

import pytest

from tallywork.sources import curriculum as R

SCHEMA = "document string, page_no int, text string"


def got(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows.collect()), key=str)


def test_programs(spark):
    pages = [
        ("d", 1, "Contents\nCourse Name: too early\nCourse Introduction: still the front"),
        ("d", 16, "Curriculum Model\n1 1 CS1xx Programming Fundamentals Core 4 (3-3)\n2 2 CS2xx PF Object Oriented Programming Core 4 (3-3)"),
        ("d", 17, ". HCI & Computer Graphics Elective 3 (2-3)\nTotal 3 (3-0) of these\nSuggested Semester Plan\n1 1 CS1xx Programming Fundamentals Core 4 (3-3)"),
        ("d", 19, "GE1xx ISLAMIC STUDIES GER 2 (2-0)\nStudy Plan for this\nX Core 3 (3-0)"),
        ("d", 60, "Course Name: Programming  Fundamentals\nCredit 3\nCourse Introduction: variables\nloops and"),
        ("d", 61, "functions Course Name: inline\nReference Materials\nBook Core 3 (3-0)\nCourse Name:\n"),
        ("d", 62, "\nIslamic Studies\nno introduction\nCourse Name: Passed Over\nCourse Introduction:\n first text"),
        ("d", 63, "Course Name: Programming Fundamentals\nCourse Introduction: the later one"),
        ("other", 60, "Course Name: Alone\nCourse Introduction: a"),
        (None, 16, None),
    ]
    df = spark.createDataFrame(pages, SCHEMA).repartition(5)
    programs = spark.createDataFrame([("d", "CS", 16), ("d", "GE", 19)], "document string, program string, page_no int")
    rows, topics = R.program_courses(df, programs)
    assert got(rows, "program", "code", "title", "credit_hours", "unparsed") == sorted(
        [("CS", "CS1xx", "Programming Fundamentals", "4 (3-3)", None), ("CS", "CS2xx", "Object Oriented Programming", "4 (3-3)", None), ("CS", None, "HCI & Computer Graphics", "3 (2-3)", None),
         ("CS", None, None, None, "Total 3 (3-0) of these"), ("GE", "GE1xx", "ISLAMIC STUDIES", "2 (2-0)", None)], key=str)
    assert got(topics, "document", "title_key", "topics") == sorted([("d", "programming fundamentals", "the later one"), ("d", "islamic studies", "first text"), ("other", "alone", "a")])
    courses = R.with_topics(rows, topics)
    assert {r.title: r.topics for r in courses.collect()}["ISLAMIC STUDIES"] == "first text"
    assert got(R.coverage(rows, courses, topics), "document", "program", "courses", "matched_topics", "unmatched_topics", "unparsed_lines", "topic_blocks") == sorted([("d", "CS", 3, 1, 2, 1, None), ("d", "GE", 1, 1, 0, 0, None), ("d", None, 4, 2, 2, 1, 2)], key=str)


def test_a_block_runs_over_pages(spark):
    pages = [("d", 60, "Course Name: Long\nCourse Introduction: p60")] + [("d", k, f"p{k}") for k in range(61, 75)] + [("d", 75, "Reference Materials\nnot this")]
    _, topics = R.program_courses(spark.createDataFrame(pages, SCHEMA).repartition(7), spark.createDataFrame([], "document string, program string, page_no int"))
    assert got(topics, "topics") == [(" ".join(f"p{k}" for k in range(60, 75)),)]


def test_schemes(spark):
    pages = [
        ("d", 1, "front 3 Not Yet 3"),
        ("d", 5, "SEMESTER-I\n1 Calculus 3 (3+0) General Education\n2. Algorithms 3(2+1)\n3 garbled 7 line 3\nTotal Credits 3 18\nplain words"),
        ("d", 9, "GUIDELINES FOR SPECIALIZATIONS\n1) algorithms 3\n2) Vision* 2+1\n3. and so on 12x"),
        ("d", 12, "COURSE LEARNING OUTCOMES (CLOS):\n1. Calculus\nBy the end of this course you integrate\n1. Derive\n2. Algorithms"),
        ("d", 13, "By the end of this course you sort\nand search"),
        ("d", 20, "CERTIFICATIONS\n3. Vision\nBy the end of this course no more"),
    ]
    rows, topics = R.scheme_courses(spark.createDataFrame(pages, SCHEMA), "BS")
    assert got(rows, "title", "credit_hours", "unparsed") == sorted([("Calculus", "3 (3+0)", None), ("Algorithms", "3(2+1)", None), ("garbled 7 line", "3", None), ("Vision*", "2+1", None)], key=str)
    assert got(topics, "title_key", "topics") == [("algorithms", "By the end of this course you sort and search"), ("calculus", "By the end of this course you integrate 1. Derive")]


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    programs = spark.createDataFrame([], "document string, program string, page_no int")
    for rows, topics in (R.program_courses(empty, programs), R.scheme_courses(empty, "BS")):
        assert rows.count() == topics.count() == R.coverage(rows, R.with_topics(rows, topics), topics).count() == 0
    with pytest.raises(Exception, match="twice"):
        R.scheme_courses(spark.createDataFrame([("d", 1, "SEMESTER-I\n1 A B 3 (3+0) Major"), ("d", 1, "again")], SCHEMA), "BS")[0].collect()


def test_mapping(spark):
    c = spark.createDataFrame([("1", "Data Mining", "sql and data mining"), ("2", "Ethics", None)], "course_id string, title string, topics string")
    found = R.course_skills(c, [("mining", ["data mining"]), ("sql", ["sql"])])
    assert got(found, "course_id", "skill", "match_source") == [("1", "mining", "title"), ("1", "mining", "topics"), ("1", "sql", "topics")]
    totals, ranked, unmatched = R.mapping_report(c, found)
    assert totals.first().asDict() == {"courses": 2, "matched_courses": 1, "skills": 2, "rows": 3, "unmatched_courses": 1}
    assert [tuple(r) for r in ranked.collect()] == [("mining", 1), ("sql", 1)] and [r.course_id for r in unmatched.collect()] == ["2"]
