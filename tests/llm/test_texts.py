"""Cut texts and sentences: held-out accuracy on texts made here, and the odd cases."""

import random

import pytest
from pyspark.sql import functions as F

from evidra.llm import sentences, truncation

SUBJECTS = ["The billing team", "A store agent", "Norvane Wireless", "The notice", "Level-two support", "My partner", "The new owner"]
VERBS = ["denied", "delayed", "reversed", "miscounted", "split", "confirmed"]
OBJECTS = ["the monthly bill credit", "a $41.20 trade-in credit", "the last 9 credits", "the activation fee of $1,204.50", "the unlock request for a Sable One"]
TAILS = ["last spring", "after 9 months", "without any notice", "in 2021", "the week the plan changed"]


def sentence(rnd):
    return f"{rnd.choice(SUBJECTS)} {rnd.choice(VERBS)} {rnd.choice(OBJECTS)} {rnd.choice(TAILS)}."


# ---- cut texts -------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def excerpts():
    rnd, rows = random.Random(11), []
    for i in range(6000):
        source = rnd.choice(["posts", "news_x", "files"])
        if source == "posts":
            body, limit = " ".join(sentence(rnd) for _ in range(rnd.randrange(1, 5))), 160
        elif source == "news_x":
            body, limit = f"{sentence(rnd)[:-1]} | paper-{rnd.randrange(4)}.test", 10**6
        else:
            body, limit = f"Co {rnd.randrange(9)} | case id={i}; award={rnd.randrange(900)}; note={sentence(rnd)}; file status={rnd.choice(['open', 'closed'])}", 10**6
        cut = body[:limit]
        if rnd.random() < 0.05:
            cut = cut[: rnd.randrange(8, len(cut) - 1)] + rnd.choice(["", "", "…", "&am"])
        rows.append((i, source, cut, cut != body))
    return rows


def test_cut_texts_are_found(spark, excerpts):
    df = spark.createDataFrame([r[:3] for r in excerpts], "rid bigint, src string, body string").withColumn("e", F.lit(1)).withColumn("kind", F.lit(2)).withColumn("id", F.lit("clash"))
    found = {r.rid for r in truncation.truncated(df, "rid", "body", "src").collect()}
    truth = {i for i, _, _, cut in excerpts if cut}
    assert len(found & truth) / len(truth) > 0.9 and len(found & truth) / len(found) > 0.9


def test_limits_are_read_off_the_table(spark, excerpts):
    df = spark.createDataFrame([r[:3] for r in excerpts], "rid bigint, src string, body string")
    forms = truncation.source_forms(df, "body", "src")
    assert {tuple(r) for r in forms.collect()} == {("posts", "prose"), ("news_x", "news"), ("files", "rows")}
    assert ("posts", 0, 160) in {tuple(r) for r in truncation.limits(truncation.shaped(df, "rid", "body", "src", forms)).collect()}


def test_a_source_of_eight_rows_has_a_limit(spark):
    bodies = [f"{i} {'word ' * 40}"[:120] for i in range(5)] + ["a whole one.", "another whole one, longer.", "and one more of these that is whole."]
    df = spark.createDataFrame([(i, "tiny", b) for i, b in enumerate(bodies)], "rid bigint, src string, body string")
    got = truncation.limits(truncation.shaped(df, "rid", "body", "src", truncation.source_forms(df, "body", "src")))
    assert [tuple(r) for r in got.collect()] == [("tiny", 0, 120)]


def test_sums_of_groups_are_sums_of_features():
    import numpy as np

    rnd = np.random.default_rng(5)
    model = truncation.TruncationModel(rnd.random(truncation.DIM) < 0.5, rnd.random(truncation.DIM + 64 * 64), {})
    for text, kind in (("A title of some kind... | paper.test", "news"), ("Prose that stops (in the", "prose"), ("Co | case=1; award=2; no", "rows"), ("In re X | D. Y | doc", "cells"), ("", "prose")):
        flat = np.array(truncation.feature_list(text, kind, True, False))
        whole = model.weights[model.index(model.known, flat, np.array([0, len(flat)]))].sum()
        groups = truncation.feature_groups(text, kind, True, False)
        assert abs(model.score(groups) - whole) < 1e-9 and abs(model.score(groups) - whole) < 1e-9


def test_cut_texts_odd_tables(spark):
    kind = "rid bigint, src string, body string"
    assert truncation.truncated(spark.createDataFrame([], kind), "rid", "body", "src").count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, None, ""), (3, "a", "  "), (4, "a", "x"), (5, None, "y" * 300_000), (5, None, "ok."), (None, "news_a", " | ")], kind)
    assert truncation.truncated(odd, "rid", "body", "src").count() >= 0


def test_cut_makes_shorter_texts():
    rnd = random.Random(3)
    for text, kind in (("Some title that is long enough | paper.test", "news"), ("abcdefghijk", "prose"), ("ab", "prose")):
        for _ in range(50):
            made, _, _ = truncation.cut(text, kind, rnd)
            assert made != text and made


# ---- sentences -------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model():
    rnd, docs = random.Random(7), []
    abbreviated = ["We paid approx. {n} weeks of fees, i.e. too much.", "See Fig. {n} of the guide, incl. the notes.", "It was filed by Dr. Vale of St. Orlen.", "They asked Dr. Quay about it, etc. and left.", "It closes at {n} p.m. on a Sunday.", "He lives in the U.S. and pays."]
    for _ in range(1500):
        paragraphs = []
        for _ in range(rnd.randrange(2, 5)):
            paragraphs.append(" ".join(sentence(rnd) if rnd.random() < 0.6 else rnd.choice(abbreviated).format(n=rnd.randrange(9)) for _ in range(rnd.randrange(1, 4))))
        docs.append("\n\n".join(paragraphs))
    docs += ["运营商取消了优惠。没有人回复！\n\n他们说：“请等。会处理。”然后没有消息了。第二天也一样。\n\n没有人回复！"] * 40 + ["บริษัทยกเลิกเครดิตครับ พนักงานไม่ตอบเลยครับ\n\nไม่มีใครตอบเลยครับ บริษัทเลื่อนสิทธิ์ครับ\n\nพนักงานไม่ตอบเลยครับ"] * 60
    return sentences.train(docs)


def cut(model, text):
    return [text[a:b] for a, b in model.units(text)]


def test_plain_and_abbreviations(model):
    text = "The notice delayed the last 9 credits in 2021. It was filed by Dr. Vale of St. Orlen. We paid approx. 3 weeks of fees, i.e. too much. It cost $1,204.50 in all. A store agent denied it last spring."
    assert cut(model, text) == ["The notice delayed the last 9 credits in 2021.", "It was filed by Dr. Vale of St. Orlen.", "We paid approx. 3 weeks of fees, i.e. too much.", "It cost $1,204.50 in all.", "A store agent denied it last spring."]


def test_quotations_and_parentheses(model):
    assert cut(model, 'He said “Wait. It will post.” and left. The notice split the last 9 credits in 2021.') == ["He said “Wait. It will post.” and left.", "The notice split the last 9 credits in 2021."]
    assert cut(model, "It failed (I know. Nobody read it.) and ended. My partner denied it in 2021.") == ["It failed (I know. Nobody read it.) and ended.", "My partner denied it in 2021."]


def test_scripts(model):
    assert cut(model, "运营商取消了优惠。他们说：“请等。会处理。”然后没有消息了。没有人回复！") == ["运营商取消了优惠。", "他们说：“请等。会处理。”然后没有消息了。", "没有人回复！"]
    assert cut(model, "พนักงานไม่ตอบเลยครับ บริษัทยกเลิกเครดิตครับ") == ["พนักงานไม่ตอบเลยครับ", "บริษัทยกเลิกเครดิตครับ"]


def test_lines_and_heads(model):
    text = "  Summary of the dispute\r\n \r\n1. The notice delayed\nthe last 9 credits in 2021. HOST: A store agent denied it last spring. no end here"
    got = cut(model, text)
    assert got[:3] == ["Summary of the dispute", "1. The notice delayed\nthe last 9 credits in 2021.", "HOST: A store agent denied it last spring. no end here"] or got[:2] == ["Summary of the dispute", "1. The notice delayed\nthe last 9 credits in 2021."]


def test_units_cover_the_text(model):
    rnd = random.Random(9)
    alphabet = "ab. A\n!?\"“”()『』。ก ๆ;·…’s1\r\t "
    for _ in range(300):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40)))
        units, at = model.units(text), 0
        for a, b in units:
            assert a < b and text[at:a].strip() == "" and not text[a].isspace() and not text[b - 1].isspace()
            at = b
        assert text[at:].strip() == ""


def test_sentences_table(spark, model):
    rows = [(1, "The notice split it in 2021. A store agent denied it last spring."), (2, None), (3, ""), (4, " \n "), (5, "x" * 500_000), (6, "a. " * 50_000), (None, "One."), (1, "One.")]
    df = spark.createDataFrame(rows, "doc bigint, body string").withColumn("t", F.lit("clash")).withColumn("i", F.lit(0)).withColumn("sent_start", F.lit(0))
    got = sentences.sentences(df, "doc", "body", model=model).collect()
    assert {r.doc for r in got} == {1, 5, 6, None} and sum(r.doc == 1 for r in got) == 3
    assert sentences.sentences(df.limit(0), "doc", "body").count() == 0


def test_case_is_judged_over_the_whole_text():
    prose = "The notice delayed the last 9 credits in 2021. A store agent denied it last spring. " * 300
    for head in ("运营商取消了优惠。", "บริษัทยกเลิกเครดิตครับ ", "ALL OF IT IS IN CAPITALS. ", "all of it is in small letters. "):
        assert sentences._case_mode(head * (4_000 // len(head) + 1) + prose) == "n"
    assert sentences._case_mode("all of it is in small letters. " * 900) == "x"


def test_quotations_close_at_any_depth():
    for between in (31, 32, 33, 500):
        text = "He said “see " + "( " * between + "one. Two.” and left."
        assert sentences._closed_spans(text) == [(text.index("“"), text.index("”"))]
    assert sentences._closed_spans("(" * 100_000 + "”" * 100_000 + ")" * 100_000) == [(0, 299_999)]


def test_token_counts_cover_all_documents(spark):
    docs = ["We paid approx. Nine fees. It failed.\n\nA store agent denied it."] * 200 + ["See Qv. Nine of it.\n\nIt failed."] * 40 + [None, "", " \n "]
    df = spark.createDataFrame(list(enumerate(docs)), "doc bigint, body string")
    got, whole = sentences.fit_model(df, "doc", "body", train_docs=10), sentences.train(docs)
    assert got.ends["qv."] == (40, 0) and got.ends["approx."] == (200, 0)
    assert (got.ends, got.pairs, got.starts) == (whole.ends, whole.pairs, whole.starts)


def test_accuracy_on_held_out_texts(model):
    rnd, right, found, made = random.Random(77), 0, 0, 0
    for _ in range(200):
        parts = [sentence(rnd) for _ in range(4)]
        text = " ".join(parts)
        got = set(cut(model, text))
        right, found, made = right + len(got & set(parts)), found + len(got), made + len(parts)
    assert right / found > 0.97 and right / made > 0.97


def test_a_break_of_two_characters_is_one():
    for text, want in (("a\r\nb", 1), ("a\r\n\r\nb", 2), ("a\rb", 1), ("a\r\rb", 2), ("a\n \t\nb", 2), ("a b", 2)):
        assert len(sentences._blocks(text)) == want


def test_addresses_of_any_host_hold_no_boundary(model):
    text = "See help.host.anywhere/a.B and write to x@y.Zed now. Then wait for the reply of the desk."
    assert [text[a:b] for a, b in model.units(text)][0] == "See help.host.anywhere/a.B and write to x@y.Zed now."
