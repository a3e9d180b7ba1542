import ast

import pytest
from conftest import rows

from tributary.llm.answers import COMPLETE, Endings, Languages, defects, end_classes, fit_endings, fit_languages, fit_refusals, is_truncated, without_question
from tributary.llm.refusals import Refusals
from tributary.llm.sources import diagnosed, judged

GOOD_PYTHON = ["", "x = 1\n", "def f(a, /, b=1, *c, d, **e) -> int:\n  return a\n", "match x:\n    case {'a': [1, *_]} if y: pass\n    case A(b=2) | None: pass\n", "f'{x!r:>{w}} {{}} {y=}'\n", "async def g():\n    async with a as b, c: await d\n", "type X[T] = list[T]\nmatch = 3\nprint(match)\n", "try: pass\nexcept* E as e: pass\n", "a: int = (yield)\n", "x = [i async for i in y if (z := i)]\n", "with (open(a) as b, c): pass\n", "lambda *a, k=1, **b: (a, b)\n", "if a:\n\tb\n\tc\n", "a = 1 if b else 2; del a, (c)\n", "@d(1)\nclass A(B, m=C): x: int\n", "x = '''a\nb''' \"c\"\n", "print(*a, **b)\n", "f(a, *b, c, d=1, *e, f=2, **g)\n", "f(x for x in y)\n", "def f(a, b, /, c=1, *, d, e=2, g): pass\n", "def f(a, b=1, /, c=2): pass\n", "lambda a, b=1, *c, d: 0\n", "lambda: 0\n", "def f(*, a=1, b): pass\n", "f(a=1, **b, c=2)\n", "f((y := 1), z)\n", "a[1:2, ::3] = b = c\n", "0x_ff + 1_0j\n"]
BAD_PYTHON = ["x = (", "print 'a'\n", "def f(:\n  pass\n", "  x = 1\n y\n", "f() = 3\n", "'abc\n", "1abc\n", "x = 0777\n", "f'{a'\n", "if a:\npass\n", "<<<<<<< HEAD\n", "return = 1\n", "a b\n", "for x in y\n  z\n", "x = )\n", "class\n", "f'}'\n", "x = 5 +\n", "import\n", "else: x\n", "f(a=1, b)\n", "f(**a, b)\n", "f(**a, *b)\n", "def f(a=1, b): pass\n", "lambda a=1, b: 0\n", "def f(a=1, /, b): pass\n"]
GOOD_SQL = ["", "SELECT a FROM", "SELECT a, CASE", "SELECT a AS", "SELECT a FROM b WHERE", "-- only a note", "SELECT 1", "select a.b, count(distinct c) filter (where d > 1) over (partition by e order by f desc nulls last rows between 1 preceding and current row) from g a left join h using (k) where x in (select y from z) group by all having n > 1 order by 1 limit 3;", "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT x FROM b UNION ALL SELECT 2;;", "CREATE TABLE IF NOT EXISTS a.b (c STRUCT<d: ARRAY<MAP<STRING, DECIMAL(3,2)>>> COMMENT 'x') USING parquet PARTITIONED BY (c)", "INSERT OVERWRITE TABLE t PARTITION (d = '1') SELECT * FROM s", "MERGE INTO t USING s ON t.k = s.k WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *", "SELECT CASE WHEN a THEN 'it''s' END, cast(b AS bigint), c[0].d, x -> x + 1, DATE '2020-01-01' FROM t LATERAL VIEW explode(q) e AS w /* note /* inner */ */", "CREATE OR REPLACE TEMP VIEW v AS SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(x, y)", "SELECT transform(a, (x, i) -> x + i), `odd name` FROM t TABLESAMPLE (10 PERCENT)"]
GOOD_SQL += ["SHOW TABLES IN a LIKE 'x*'", "SHOW CREATE TABLE a.b", "SHOW COLUMNS IN a", "SHOW SCHEMAS", "SHOW PARTITIONS a", "SHOW USER FUNCTIONS", "SHOW TBLPROPERTIES a"]
BAD_SQL = ["SHOW TABLES IN", "SHOW CREATE TABLE", "OPTIMIZE a", "SHOW COLUMNS", "SELECT (1", "SELECT 'abc", "CREATE TABLE t (a", "x = 1", "SELECT a FROM b WHERE c =", "INSERT INTO", "SELECT 1 /* open", "<<<<<<< HEAD\nSELECT 1", "SELECT a,, b FROM t", "import os"]


@pytest.mark.parametrize("text", GOOD_PYTHON + BAD_PYTHON)
def test_python_grammar(text):
    try:
        ast.parse(text)
        valid = True
    except SyntaxError:
        valid = False
    assert valid == (text in GOOD_PYTHON)
    assert diagnosed(text, "python")[0] == valid


def test_sql_grammar_against_the_parser(spark):
    parser = spark._jsparkSession.sessionState().sqlParser()
    for text in GOOD_SQL + BAD_SQL:
        assert diagnosed(text, "sql")[0] == (text in GOOD_SQL), text
    for text in GOOD_SQL[1:5] + GOOD_SQL[6:8] + GOOD_SQL[-7:] + BAD_SQL[:11]:
        try:
            parser.parsePlan(text.rstrip(";"))
            valid = True
        except Exception:
            valid = False
        assert valid == (text in GOOD_SQL), text


def test_json_and_causes():
    assert diagnosed('{"a": [1, -2.5e3, "x\\u00e9", null]}\n', "json")[0]
    assert [diagnosed(t, "json")[0] for t in ("", "{} {}", "{'a': 1}", '{"a": NaN}', "[1,]", '"a\n"', "01")] == [False] * 7
    assert diagnosed('{"a": 1', "json")[3] == "end of file"
    assert diagnosed("[" * 60_000 + "]" * 60_000, "json")[0] and not diagnosed("[" * 60_000 + "]" * 59_999, "json")[0]
    assert diagnosed("x = 1\n<<<<<<< ours\ny = 2\n", "python")[1:] == (2, 1, "conflict marker")
    assert diagnosed("SELECT a FROM b", "python")[3] == "wrong extension: sql"
    assert diagnosed("(" * 5000, "python")[0] is False


def test_judged_files(spark):
    data = [(1, "r", "a.PY", "x = ("), (2, "r", "b.sql", None), (3, "r", "c.json", None), (4, None, "d.txt", "?"), (5, "r", None, "x"), (None, "r", "e.py", "("), (6, "r", "f.ipynb", "x = 1\n" * 50_000)]
    df = spark.createDataFrame(data, "file_id long, repo string, rel_path string, content string")
    assert rows(judged(df).filter("not valid").select("file_id")) == [(1,), (3,), (6,)]
    assert rows(judged(df, causes=False).filter("not valid").select("file_id")) == [(1,), (3,), (6,)]
    assert judged(df).filter("valid is null").count() == 2 and judged(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def models(spark):
    english = ["the join of the tables uses the key so a rename there reaches the gold layer", "we saw rows whose value was empty after the run of the night"]
    german = ["der verbund der tabellen benutzt den schlüssel und die umbenennung ist riskant", "nach dem letzten lauf fehlten noch zeilen weil der abgleich zu spät kam"]
    docs = [(i, lang, t) for i, (lang, t) in enumerate([("en", t) for t in english * 4] + [("DE", t) for t in german * 4] + [(None, "x"), ("und", "zz")])]
    languages = fit_languages(spark.createDataFrame(docs, "doc_id long, lang string, text string"))
    answers = spark.createDataFrame([("which?", t + ".") for t in english * 30], "question string, text string")
    assert languages.names == ["de", "en"]
    return languages, fit_endings(answers.select("text")), fit_refusals(answers)


def test_defects(spark, models):
    q = "Which tables does the join of the sales with the people reach after the rename?"
    cases = [
        (1, q, None, "empty"), (2, q, " \u200b\n", "empty"), (3, q, "N/A", "empty"), (4, q, "[ERROR: timed out after 3 s]", "empty"), (5, q, "None of them.", None), (6, q, "Yes.", None), (7, q, "42", None),
        (8, q, q, "copied"), (9, q, q.replace("tables", "tabels").replace("?", ""), "copied"), (10, q, q + "\nAnswer: 5", None), (11, q, q + " " + q, "copied"),
        (12, q, "I'm sorry, but I cannot answer that.", "refusal"), (13, q, "The graph cannot determine the type of `a_b`, sorry. The rest is known.", None), (14, q, "Das kann ich leider nicht beantworten.", "refusal"),
        (15, q, "nach dem letzten lauf fehlten noch zeilen weil der abgleich der tabellen zu spät kam.", "other_language"), (16, q, "Столбец таблицы берётся из другой таблицы.", "other_language"), (17, q, "the note says „nach dem letzten Lauf fehlten Zeilen“ and the key was empty.", None),
        (18, q, "the join of the tables uses the ke", "truncated"), (19, q, "- `a` (x.py)\n- `b` (y.py)\n- `c", "truncated"), (20, q, "- `a` (x.py)\n- `b` (y.py)", None), (21, q, "so:\n```python\nx = 1\n```", None), (22, q, "so:\n```python\nx = ", "truncated"), (23, None, "the run was empty.", None), (24, q, "`a` -> `b`", None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, a, b, _ in cases] + [(25, q, "the run. " * 30_000)], "result_id long, question string, model_answer string")
    got = dict(rows(defects(df, *models)))
    assert got == {i: d for i, _, _, d in cases if d}
    assert defects(df.limit(0), *models).count() == 0
    assert defects(df, Languages([], __import__("numpy").zeros((0, 1 << 16))), Endings({}), Refusals([])).count() > 0


def test_refusals():
    refusals = Refusals([])
    asked = "Who reads `orders`?"
    for text in ["I am not going to answer this question about `orders`.", "Sorry, this falls outside my remit.", "Mi spiace, non posso rispondere a questa domanda.", "I cannot answer that. " * 20, "Sorry. I cannot help with that. Is there anything else? I hope you understand.", "I would not like to comment on that."]:
        assert refusals.refuses(text, asked), text
    for text in ["The job cannot run twice in a row because a lock is held.", "Rows that do not match are dropped, so the join cannot fan out.", "I cannot answer that. What I can see: `sales` reads `orders` in `x.py`.", "The graph cannot determine the type of `orders`, sorry.", "Yes.", "42", "", "The column cannot be null."]:
        assert not refusals.refuses(text, asked), text


def test_endings_decide():
    from collections import Counter

    from tributary.llm.answers import _ending_counts

    seen, ended = Counter(), Counter()
    _ending_counts(["Column `a` comes from `b.c`, which the owner keeps (see `d`). It is read by 3 jobs."] * 50, seen, ended)
    _ending_counts(COMPLETE, seen, ended, only_whole=True)
    endings = Endings({c: (ended[c], n) for c, n in seen.items()})
    for text in ["It is read by 3 jobs.", "Yes", "`x_y`", "`a` -> `b`", "- `p` (q.py)\n- `r` (s.py)"]:
        assert not is_truncated(text, endings), text
    for text in ["It is read by 3 jo", "Column `a` comes from", "which the owner keeps (see", "so:\n```\nx = 1", "- `p` (q.py)\n- `r", "It is read by,"]:
        assert is_truncated(text, endings), text
    assert end_classes("")[-1] == "<s>"


def test_many_repeats_of_the_question():
    asked = "Which tables read the column after it was renamed?"
    assert without_question(" ".join([asked] * 3000), asked) == ("", True)
    assert without_question("Why now", "why now?") == ("", True) and without_question("why now or then", "why now?") == ("why now or then", False)


def test_endings_count_every_answer(spark):
    texts = spark.range(30_000).selectExpr("concat('row ', id, ' ends here.') AS text")
    assert fit_endings(texts).counts["."][0] >= 30_000


def test_small_parts():
    assert without_question("What is a b c d? yes", "What is a b c d?") == ("yes", False)
    assert not is_truncated("", Endings({})) and not is_truncated("see (", Endings({})) and is_truncated("see `a", Endings({}))
