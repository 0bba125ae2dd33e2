from keylink.llm.chat import link_quotes

SCHEMA = "conv_id long, turn long, role string, text string, _row string, place string"


def rows_of(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {(r["conv_id"], r["turn"]): r for r in link_quotes(frame).collect()}


def test_nested_quotes_link_to_their_messages(spark):
    got = rows_of(spark, [
        (1, 0, "user", "How do I  sort\nTwo keys?"),
        (1, 1, "assistant", "> How do i sort\nUse sort_values."),
        (1, 2, "user", ">> how do I sort\n> Use sort_values.\n>\n> never said\nThanks"),
        (1, 3, "user", "> Two keys?\n > how do i SORT\nI meant the first"),
        (2, 0, "user", "> How do I sort\nother conversation"),
        (1, 4, None, None), (None, 0, "user", "plain"), (1, None, "system", "Be kind"), (1, 5, "user", ""),
    ])
    link = lambda c, t: (got[c, t]["reply_to"], got[c, t]["clean_text"], got[c, t]["n_quoted"], got[c, t]["n_linked"])
    assert link(1, 0) == (None, "How do I  sort\nTwo keys?", 0, 0)
    assert link(1, 1) == (0, "Use sort_values.", 1, 1)
    assert link(1, 2) == (1, ">\n> never said\nThanks", 3, 2)
    assert link(1, 3) == (0, "I meant the first", 2, 2)
    assert link(2, 0) == (None, "> How do I sort\nother conversation", 1, 0)
    assert link(1, 4) == (None, None, 0, 0)
    assert got[1, 1]["formatted"] == "<|assistant|>\nUse sort_values."
    assert got[1, 4]["formatted"] is None and got[None, 0]["clean_text"] == "plain"
    assert got[1, 0]["_row"] == "x" and got[1, None]["place"] < got[1, 0]["place"]


def test_the_latest_source_and_repeated_rows(spark):
    rows = [(1, t, "user", "same line") for t in range(4)] + [(1, 4, "user", "> same line")] * 2
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = [r["reply_to"] for r in link_quotes(frame).collect() if r["turn"] == 4]
    assert got == [3, 3]
    assert link_quotes(spark.createDataFrame([], SCHEMA)).collect() == []
