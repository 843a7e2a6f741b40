"""Encoding of characters takes no text apart into rows."""

from voxtile.functions import text as T


def test_texts_stay_whole(spark):
    rows = [("a", "aé𝄞a"), ("b", "é\x00 ?"), ("c", ""), ("d", None), ("e", "𝄢\U0010ffff")]
    df = spark.createDataFrame(rows, "id string, text string")
    out = T.encoded_characters(df, "text", T.vocabulary(spark.createDataFrame([("é𝄞 a\x00",)], "text string"), "text"), eos=False)
    of = {c: 4 + i for i, c in enumerate(sorted("é𝄞 a\x00"))}
    assert sorted((r.id, r.ids) for r in out.collect()) == [(i, [2, *[of.get(c, 1) for c in t]]) for i, t in rows if t is not None]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Generate", "SortMergeJoin", "hashpartitioning"))


def test_no_characters(spark):
    df = spark.createDataFrame([("a", "x")], "id string, text string")
    out = T.encoded_characters(df, "text", T.vocabulary(df.where("id = 'b'"), "text"))
    assert [tuple(r) for r in out.collect()] == [("a", [2, 1, 3])]
