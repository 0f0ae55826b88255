import re

from tidewell.llm import lines

LONG = "Posted by the author {} on a fine morning of the {} year in our town and everybody cheered loudly"


def clean(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, t string, o int")
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "__lines"]
    return {(r.doc_id, r.t): (r.text, r["__lines"].n_dropped) for r in out.collect()}, out


def body(k):
    return "\n".join(f"{w} has its own sentence here number {w}{w} and goes on" for w in (f"w{c}" for c in "abcdefgh"[k : k + 1])) + f"\nunique closing words {'z' * k} of this particular document come last of all"


def test_exact_and_generalised_lines(spark):
    word = ["anna", "bert", "carl"]
    rows = [(i, f"{LONG.format(word[i - 1], 1990 + i)}\n{chr(96 + i) * 5} something quite {chr(105 + i) * 7} entirely {chr(100 + i) * 3} different {i * 'q'}\n{'lorem' * i} x{i * 'y'} and the rest of text {i * 'k'} is {i * 'v'} longer still here {i * 'b'}") for i in (1, 2, 3)]
    got, _ = clean(spark, rows)
    assert got[1, "x"] == (rows[0][1], 0)
    for i in (2, 3):
        assert got[i, "x"] == (rows[i - 1][1].split("\n", 1)[1], 1)


def test_every_recurring_line_goes_whatever_its_length_or_share(spark):
    text = "one line of five words\nanother line of six whole words\nok then"
    got, _ = clean(spark, [(1, text), (2, text), (3, "ok then\nfresh words in a new line\n\nok THEN"), (4, "\nok then"), (5, "one line of four words")])
    assert got[1, "x"] == (text, 0) and got[2, "x"] == ("", 3)
    assert got[3, "x"] == ("fresh words in a new line\n\nok THEN", 1)
    assert got[4, "x"] == ("", 1) and got[5, "x"] == ("", 1)  # one field of the tail varies


def test_fields_of_short_lines(spark):
    got, _ = clean(spark, [(1, "posted by the anna\nwe all meet"), (2, "posted by the bert\nwe all ate\npage 3"), (3, "posted by one bert\npage 17")])
    assert got[2, "x"] == ("we all ate\npage 3", 1) and got[3, "x"] == ("posted by one bert", 1)


def test_odd_rows(spark):
    mine = "a b c d e\nthis is the longer line that only occurs in one document, really"
    got, out = clean(spark, [(5, None), (6, ""), (None, mine), (4, "a b c d e\n" + "own words " * 5000), (4, "a b c d e\n" + "own words " * 5000)])
    assert got[5, "x"] == (None, 0) and got[6, "x"] == ("", 0)
    assert got[None, "x"] == (mine.split("\n")[1], 1)
    assert got[4, "x"][1] == 0 and out.count() == 5
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_and_dotted_columns(spark):
    docs = spark.createDataFrame([(1, "same line here", 1, 2, 3, 4, 5), (2, "same line here\nown", 1, 2, 3, 4, 5)], "doc_id long, text string, __lines int, `a.b` int, row int, gone int, lines int")
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "__lines_"]
    assert sorted(tuple(r)[:7] for r in out.collect()) == [(1, "same line here", 1, 2, 3, 4, 5), (2, "own", 1, 2, 3, 4, 5)]


def test_thousands_of_lines_in_one_text(spark):
    long = "\n".join(f"{chr(97 + i % 26) * (2 + i // 26)} goes here" for i in range(20_000))
    got, _ = clean(spark, [(1, long), (2, long + "\nthe end of it all")])
    assert got[1, "x"] == (long, 0) and got[2, "x"] == ("the end of it all", 20_000)


def test_template_repeats_in_one_document_are_kept(spark):
    got, _ = clean(spark, [(1, "same line in here twice\nsame line in here twice"), (2, "other words are there only")])
    assert got[1, "x"][1] == 0


def test_corpus_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    seen = {}

    def keys(line):
        t = [x for x in re.split(r"[ \t\r\x0b\x0c]+", re.sub("[0-9]+", "<*>", line)) if x]
        if t:
            yield ("full", *t)
        if len(t) > 3:
            for i in range(3):
                a, b = (3 + (len(t) - 3) * j // 3 for j in (i, i + 1))
                if a < b:
                    yield (i, len(t), tuple(t[:a]), tuple(t[b:]))

    for i, t in rows:
        for line in t.split("\n"):
            for k in keys(line):
                seen.setdefault(k, set()).add(i)
    want = {}
    for i, t in rows:
        ls = t.split("\n")
        gone = {n for n, line in enumerate(ls) if any(min(seen[k]) < i for k in keys(line))}
        want[i] = "\n".join(x for n, x in enumerate(ls) if n not in gone)
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == want
    assert sum(want[i] != t for i, t in rows) > 3


def test_texts_are_masked_whole_before_their_lines_are_taken(spark):
    docs = spark.createDataFrame([(1, "a\tb 12\x0b3\rc\x0cd  e\n\t\n7up 3 x"), (2, " a b 4  55 c d e \n9up\t10 x\nü b"), (3, None)], "doc_id long, text string")
    keyed = lines.template_lines(docs)
    plan = keyed._jdf.queryExecution().analyzed().toString().split("\n")
    assert all("posexplode" in x for x in plan if "regexp_replace" in x or "RLIKE" in x) and "regexp_replace" in "".join(plan)
    got = {}
    for r in keyed.collect():
        got.setdefault((r.o, r.no), set()).add((r.k1, r.k2))
    assert sorted(got) == [(1, 0), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert got[1, 0] == got[2, 0] and len(got[1, 0]) == 4 and got[1, 2] == got[2, 1] and len(got[2, 2]) == 1
