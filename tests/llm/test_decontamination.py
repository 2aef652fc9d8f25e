"""Short items in long documents, found through sketches of any size."""

import random

from candlewake.llm import decontamination as D


def test_items_are_found_in_documents_of_all_sizes(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(50_000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 7, 12, 30, 60])))) for i in range(60)]
    docs = []
    for i in range(240):
        text = [word() for _ in range(rng.choice([0, 3, 40, 600, 6000]))]
        item = items[i % 60][1].split()
        if i % 3:
            item = item[: len(item) * 9 // 10] if i % 3 == 2 else item
            at = rng.randrange(len(text) + 1)
            text[at:at] = item
        docs.append((i, " ".join(text).upper() if i % 5 == 0 else " ".join(text)))
    docs.append((1, None))

    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    whole = {}
    for d, t in docs:
        whole.setdefault(d, set()).update(sets(t))
    want = {
        (d, i, len(sets(t) & s), len(sets(t)))
        for i, t in items
        for d, s in whole.items()
        if 100 * len(sets(t) & s) >= 75 * len(sets(t))
    }
    got = D.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_null_keys_and_extra_columns(spark):
    text = "the quick brown fox jumps over the lazy dog again"
    docs = spark.createDataFrame([(None, text, 1), (2, text, 1), (3, "nothing of that", 1)], "doc_id long, text string, id int")
    items = spark.createDataFrame([(1, text), (None, text)], "item_id long, text string")
    assert {(r.id, r.item_id) for r in D.contaminated(docs, items).collect()} == {(None, 1), (None, None), (2, 1), (2, None)}
    assert [tuple(r) for r in D.clean(docs, items).collect()] == [(3, "nothing of that", 1)]


def test_rows_of_one_key_are_cleaned_one_by_one(spark):
    item = [f"w{i}" for i in range(40)]
    parts = [" ".join(item[:22]), " ".join(item[18:])]
    rows = [(k, t) for k in (None, 1) for t in (*parts, " ".join(item), "nothing of that", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{x} " + " ".join(item)) for i in (None, 5) for x in ("a", "b c d e f g h")], "item_id long, text string")
    got = [tuple(r) for r in D.clean(docs, items).collect()]
    assert sorted(got, key=str) == sorted((r for r in rows if r[1] != " ".join(item)), key=str)
    far = spark.createDataFrame([(None, " ".join(item)), (None, " ".join(f"v{i}" for i in range(90)))], "item_id long, text string")
    assert D.clean(docs, far).count() == 8
