"""Line templates on small fixtures; the SQL twin is held against the sample tables."""

import random
import re
from hashlib import md5

from pyspark.sql import functions as F

from gleaner.llm import lines

SCHEMA = "doc_id BIGINT, text STRING, _id STRING"


def kept(spark, rows, **parameters):
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], SCHEMA)
    out = lines.dedup_lines(df, **{"min_docs": 3, **parameters}).collect()
    assert all(r._id == "own" for r in out) and len(out) == len(rows)
    return {r.doc_id: (r.text, r.n_dropped) for r in out}


def test_templates_with_variable_fields_recur(spark):
    rows = [(i, f"{'abcdefg'[i]} has own words\nPage {i} of 90 was printed at noon\n{'tuvwxyz'[i]} ends it") for i in range(5)]
    rows += [(9, "Page 7 of 90 was printed at dusk\nalone")]
    got = kept(spark, rows)
    assert got[0] == (rows[0][1], 0)  # the first document keeps its line
    assert got[3] == ("d has own words\nw ends it", 1)
    assert got[9] == ("alone", 1)  # one word differs: a variable field


def test_different_lines_of_a_leaf_stay(spark):
    rows = [(i, "we saw the " + t) for i, t in enumerate(["river bend north", "castle wall stand", "empty barn burn"])]
    assert all(n == 0 for _, n in kept(spark, rows).values())


def test_several_templates_of_a_leaf(spark):
    names = "bob ann eve joe kim lea max ned".split()
    forms = ["user {} logged in", "disk {} is full", "host {} went down"]
    rows = [(8 * k + i, f"2024-01-0{i + 1} 10:00:0{i} {i} " + form.format(names[(i + k) % 8])) for k, form in enumerate(forms) for i in range(8 - k)]
    got = kept(spark, rows, min_docs=6)
    firsts = {0, 8, 16}
    assert {i for i, (_, n) in got.items() if n == 0} == firsts
    assert all(text == "" for i, (text, _) in got.items() if i not in firsts)


def test_long_lines_recur_from_two_documents(spark):
    for k in (2, 3, 7):
        long = " ".join(f"word{i}" for i in range(50))
        rows = [(i, f"own {'abcdefg'[i]}\n{long}\nshort line of some words") for i in range(k)] + [(20, long.replace("word7 ", "word8 "))]
        got = kept(spark, rows, min_docs=9)
        assert got[0] == (rows[0][1], 0) and got[20] == (rows[-1][1], 0)
        assert all(got[i] == (f"own {'abcdefg'[i]}\nshort line of some words", 1) for i in range(1, k))
        assert all(n == 0 for _, n in kept(spark, rows, min_docs=9, long_docs=None).values())


def in_duckdb(rows):
    import duckdb

    from gleaner.llm.queries import ORACLES

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return {i: (n, md5) for i, n, md5 in con.execute(ORACLES["op4_line_templates"]).fetchall()}


def test_twin_with_several_templates_of_a_leaf(spark):
    rng = random.Random(9)
    names = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    forms = ["user {} logged in again", "disk {} is full now", "host {} went down early", "link {} came up late", "node {} shut off soon"]
    rows = []
    for k, form in enumerate(forms):
        for i in range(30 - 5 * k if k < 3 else 12):
            # two names for the last forms: values of their field are frequent themselves
            name = rng.choice(names) if k < 3 else names[i % 2]
            rows.append((len(rows), f"own {'abcdefghij'[i % 10]}{k}\n10:00:0{i} {i} on {form.format(name)}\nend of entry" + " x" * (i % 3)))
    rng.shuffle(rows)
    got = {i: (n, md5(text.encode()).hexdigest()) for i, (text, n) in kept(spark, rows, min_docs=lines.MIN_DOCS).items()}
    assert got == in_duckdb(rows)
    firsts = [min(i for i, t in rows if form.split(" {}")[0] in t) for form in forms]
    assert all("on " + form.split(" {}")[0] in dict(rows)[i] for i, form in zip(firsts, forms, strict=True))
    assert sum(" on " in text for text, _ in kept(spark, rows, min_docs=lines.MIN_DOCS).values()) == len(forms)


def test_number_of_tables_does_not_grow_with_lines(spark, monkeypatch):
    rng, made = random.Random(1), []
    count = lambda df, name, w=lines.written: (made.append(name), w(df, name))[1]
    monkeypatch.setattr(lines, "written", count)
    for n in (12, 48):
        made.clear()
        base = [f"w{chr(97 + i % 26)}" for i in range(n)]
        rows = [(d, " ".join(w if i < 3 or rng.random() < 0.6 else "abc"[rng.randrange(3)] * 2 for i, w in enumerate(base))) for d in range(20)]
        got = kept(spark, rows, min_docs=lines.MIN_DOCS)
        assert len(made) <= 15
        assert {i: (n, md5(t.encode()).hexdigest()) for i, (t, n) in got.items()} == in_duckdb(rows)


def test_a_text_is_split_once_and_not_carried_by_its_lines(spark):
    rows = [(i, f"own {'abc'[i]}\nsame words here\nlast {'xyz'[i]}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    table = plan(lines.line_table(docs))
    assert table.count("split(") == 1
    above = table[: table.index("Generate")]
    assert "xxhash64(text" not in above and "text#" not in above
    # in the text that is put together again, no split inside the function of each line
    rest = plan(lines.dedup_lines(docs, min_docs=3))
    assert rest.count("split(") == 1 and "element_at(split(" not in rest
    assert kept(spark, rows) == {0: (rows[0][1], 0), 1: ("own b\nlast y", 1), 2: ("own c\nlast z", 1)}


def test_words_of_odd_lines(spark):
    odd = ["", " ", "a", " a  b ", "a\tb", "\ta b\r", "x\x0B\x0Cy  z", "ä  1ö 2\t", "a\u00a0b", "1", "a 1b2 <*> 3", "a\x00 b", "\u20281 2"]
    df = spark.createDataFrame([(t,) for t in odd], "t STRING").withColumn("own", lines.spaced(F.col("t")))
    got = df.select("t", "own", lines.masked(F.col("own")).alias("masked"), lines.n_words(F.col("own")).alias("n")).collect()
    for r in got:
        words = re.findall(r"[^ \t\r\f\x0B]+", r.t)
        assert r.own == " ".join(words) and r.n == max(len(words), 1)
        assert r.masked == " ".join("<*>" if re.search("[0-9]", w) else w for w in words)


def test_few_documents_and_repeats_inside_one(spark):
    assert all(n == 0 for _, n in kept(spark, [(1, "same line here\n" * 9), (2, "same line here")]).values())


def test_first_document_keeps_all_its_lines(spark):
    got = kept(spark, [(4, "x y z\nx y z"), (5, "x y z"), (6, " x  y z \nother")])
    assert got == {4: ("x y z\nx y z", 0), 5: ("", 1), 6: ("other", 1)}


def test_odd_rows(spark, odd, nothing):
    rows = lines.dedup_lines(odd, min_docs=2).collect()
    assert len(rows) == 12 and set(odd.columns) < set(rows[0].asDict())
    by = {r.doc_id: r for r in rows}
    assert by[1].text is None and by[2].text == "" and by[3].text == " \n\t " and by[None].text == "no id here"
    assert by[7].text == "" and by[7].n_dropped == 1 and by[5].n_dropped == 0
    assert lines.dedup_lines(nothing).count() == 0
