"""The index of words against the scoring of whole texts."""

import random

from pyspark.sql import functions as F

from fieldbook.operators import search, vocabulary
from fieldbook.sources.published import Folder, shared_folder


def test_lookups_find_all_near_words():
    """Every word within two edits is filed under a key that is looked up."""
    rnd = random.Random(3)
    for _ in range(3000):
        token = "".join(rnd.choice("abc1") for _ in range(rnd.randint(2, 12)))
        word = list(token)
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(word) + 1)
            kind = rnd.choice("ids")
            if kind == "i":
                word.insert(at, rnd.choice("abcx"))
            elif word and at < len(word):
                word[at : at + 1] = [] if kind == "d" else [rnd.choice("abcx")]
        word = "".join(word)
        if word:
            keys = {f"{len(word)}:{k}:{word[b : b + n]}" for k, (b, n) in enumerate(vocabulary._thirds(len(word)))}
            assert keys & vocabulary.lookups(token), (token, word)


def test_index_scores_as_texts_do(spark):
    rnd = random.Random(6)
    words = ["legal", "legl", "aid", "x_aid", "aid_x", "_legal", "the", "Paralegal", "LAN", "lan2", "555", "housing", "housng", "übung", "é", "a", "network" * 5, "b-c"]
    text = lambda: rnd.choice([None, "", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))])
    fields = ["name", "acronym", "tags", "description", "address", "source_note", "phone_normalized"]
    rows = spark.createDataFrame([(i, rnd.randint(0, 2), *[rnd.choice([text(), rnd.choice(words)]) for _ in fields]) for i in range(120)], "id int, priority int, " + ", ".join(f"{f} string" for f in fields))
    questions = {"a": "legal aid", "b": "LAN lan the", "c": "housing housing 555", "d": "of the", "e": "ab legaal netwrok", "f": "network" * 5, "g": "bung"}
    found = vocabulary.Index(spark, shared_folder(spark)).build(rows).search(questions)
    got = {(r["question"], r["id"]): (round(r["score"], 6), r["matched"]) for r in found.collect()}
    want = {}
    for name, asked in questions.items():
        if search.query_tokens(asked):
            for r in search.score(rows.withColumn("priority", F.lit(0)), asked).where("score > 0").collect():
                want[name, r["id"]] = (r["score"], r["matched"])
    assert got == want and len(got) > 100
    assert vocabulary.Index(spark, shared_folder(spark)).build(rows.where("id < 0")).search(questions).count() == 0
    assert vocabulary.Index(spark, shared_folder(spark)).build(rows).search({"d": "of the"}).count() == 0


def test_index_has_a_row_a_field_and_words_go_to_the_lists(spark, monkeypatch):
    """Neither a row for each word of a record is written, nor are all words shuffled to meet the few that score; where these are many, the rows are the same."""
    rows = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{k}" for k in range(300)) + " legal_aid", "legal help") for i in range(40)], "id int, description string, name string")
    path = shared_folder(spark)
    index = vocabulary.Index(spark, path).build(rows)
    written = [f for f in Folder(spark, path).names() if f not in ("words", "thirds")]
    assert [spark.read.parquet(f"{path}/{f}").count() <= 4 * 40 for f in written] == [True]
    shuffles = lambda found: "hashpartitioning(word" in found._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = index.search({"a": "legal aid w3x2", "b": "halp"})
        assert not shuffles(few)
        monkeypatch.setattr(vocabulary, "SENT", 0)
        many = index.search({"a": "legal aid w3x2", "b": "halp"})
        assert shuffles(many) and sorted(few.collect()) == sorted(many.collect()) and few.count() == 80
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
