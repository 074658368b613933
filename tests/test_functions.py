"""Column functions on small texts."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import extract as X
from tessella.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "mode", "want"), [
    ("Reasoning. The answer is Paris. The answer is London.", "first_answer_span_v1", "Paris"),
    ("The answer is Ada Lovelace. So the answer is Grace Hopper.", "first_answer_span_v1", "Ada Lovelace"),
    ("The answer is blue.</s> Question: unrelated", "first_answer_span_v1", "blue"),
    ("Only reasoning, no marker.", "first_answer_span_v1", ""),
    ("Reasoning. The answer is yes. Both places are in France.", "first_answer_sentence_v2", "yes"),
    ("Reasoning. The answer is New York City. It is the largest city.", "first_answer_sentence_v2", "New York City"),
    ("Question: first. a #10000000 b", "raw_v1", "Question: first. a"),
])
def test_extractors(spark, text, mode, want):
    assert one(spark, X.extractor(mode)(F.col("t")), t=text) == want


def test_extractor_modes(spark):
    with pytest.raises(ValueError):
        X.extractor("legacy_original")
    with pytest.raises(ValueError):
        X.extractor("other")
    assert one(spark, X.extractor("legacy_original", F.upper)(F.col("t")), t="a Note: b") == "A "


def test_normal_forms(spark):
    assert one(spark, T.normalize_text("t"), t="Alpha_Page!") == "alpha page"
    assert one(spark, T.normalize_title("t"), t="Romeo + Juliet") != one(spark, T.normalize_title("t"), t="Romeo ～ Juliet")
    assert one(spark, T.normalize_answer(F.col("t")), t="The  Cat's an-swer, a") == "cats answer"
    assert one(spark, T.normalize_answer(F.col("t"), True), t="The  Cat's") == "the cats"


def test_tags(spark):
    good = "x</step><subquery>q</subquery><retrieval>r</retrieval><step>s</step><subanswer>a</subanswer><step>t</step><answer>f</answer>"
    assert one(spark, X.format_reward(F.col("t")), t=good) == 1 and one(spark, X.format_reward(F.col("t")), t=good + "<step>") == -1
    assert one(spark, X.last_tagged_answer(F.col("t")), t="So the answer is <answer>a. b</answer> or <answer>c. d</answer>") == "c"
    assert one(spark, X.wrap_clauses(F.col("t")), t='So the next query is "who?". So the answer is Rome.') == "So the next query is <query>who?</query> So the answer is <answer>Rome</answer>"
    assert one(spark, X.wrap_clauses(F.col("t")), t="So the answer is <answer>x</answer>") == "So the answer is <answer>x</answer>"
    wrapped = {
        "So the next is a \"b\" c. So the answer is “x”. So the answer is y.": "So the next is <query>a b c</query> So the answer is <answer>“x”</answer> So the answer is <answer>y</answer>".replace("“x”", "x"),
        "no clause at all.": "no clause at all.",
        "So the answer is <answer>x</answer>. So the answer is z": "So the answer is <answer>x</answer> So the answer is <answer>z</answer>",
        "first\nSo the answer is two\nlines.\n": "first\nSo the answer is <answer>two\nlines</answer>",
        "": "",
        None: None,
    }
    for text, want in wrapped.items():
        assert one(spark, X.wrap_clauses(F.col("t").cast("string")), t=text) == want
    assert one(spark, X.last_integer(F.col("t")), t="1 and -12 or") == -12.0 and one(spark, X.last_integer(F.col("t")), t="none") is None


def test_ids_and_json(spark):
    a = one(spark, T.stable_id("s", {"b": F.lit(1), "a": F.col("t")}), t="é")
    assert a == one(spark, T.stable_id("s", {"a": F.col("t"), "b": F.lit(1)}), t="é") and len(a) == 22
    assert json.loads(one(spark, F.to_json(T.salvage_json(F.col("t"))), t='so: {"a": {"b": 1}} end')) == {"a": {"b": 1}}
    assert one(spark, T.salvage_json(F.col("t")).isNull(), t="{broken") is True
    title, body = T.title_and_body(F.col("t"))
    assert one(spark, F.concat_ws("|", title, body), t='"A title" \nline\nmore') == '"A title|line\nmore'.replace('"', "") and one(spark, F.concat_ws("|", title, body), t="all") == "all|"
    assert one(spark, T.is_content_word(F.col("t"), F.col("w")), t="Rome's", w=["Rome"]) is True


def test_passages(spark):
    df = spark.sql("SELECT array(named_struct('rank', 2, 'title', 'B', 'text', 'b'), named_struct('rank', 1, 'title', 'A', 'text', 'a')) AS p")
    assert df.select(T.passages_text(F.col("p"))).first()[0] == "Doc 1(Title: A) a\nDoc 2(Title: B) b\n"
