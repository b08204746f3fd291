"""Operators cover all rows: repeated and null ids with different texts, and texts of no known language."""

import hashlib
import itertools
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from logweir.llm import langid, linededup, minhash, stages, toxicity

LINE = "A line that many documents share, word for word."


def test_lines_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(i, f"own {i}\n{LINE}") for i in range(6)] + [(None, f"{LINE}\nfoo"), (None, "bar\nbaz"), (2, f"{LINE}\nx"), (2, "y\nz"), (2, f"{LINE}\nx"), (9, LINE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.row.doc_id is None, r.row.doc_id or 0, r.n_dropped, r.kept) for r in linededup.apply(docs).collect())
    want = [(i is None, i or 0, t.split("\n").count(LINE) * (i != 9), "\n".join(x for x in t.split("\n") if x != LINE or i == 9)) for i, t in rows]
    assert got == sorted(want)
    # The SQL as registered, over the rows with an id.
    docs.where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in linededup.op6_line_dedup(spark, str(tmp_path)).collect()) == sorted(con.sql(linededup.OP6_SQL).fetchall())


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 999)}" for _ in range(120)] for _ in range(12)]
    near = lambda k, i: " ".join(base[k][:i] + [f"changed{i}"] + base[k][i + 1 :])
    # Ids 1 to 3 hold four texts each; each text has a near copy of its own, and those are linked through the shared id.
    rows = [(1 + k // 4, near(k, 5)) for k in range(12)] + [(100 + k, near(k, 60)) for k in range(12)] + [(None, near(0, 30)), (None, near(1, 30)), (200, "none like it")]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85, bands=24).collect()}
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    root = {i: i for i, _ in rows if i is not None}
    for (i, x), (j, y) in itertools.combinations([(i, s) for (i, _), s in zip(rows, sets) if i is not None], 2):
        if 100 * len(x & y) >= 85 * len(x | y):
            a, b = sorted((root[i], root[j]))
            root = {k: a if v == b else v for k, v in root.items()}
    assert got == {*root.items(), (None, None)} and sum(v < 4 for v in root.values()) == 15


def test_language_stage_rejects_gibberish_and_unlearned_languages(spark):
    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    random_text = lambda chars, n: " ".join("".join(rng.choice(chars) for _ in range(rng.randint(2, 9))) for _ in range(n))
    texts = [random_text(chars, n) for n in (3, 20, 200) for chars in ("abcdefghijklmnopqrstuvwxyz", "abcxyz#@!%&*()[]{};:<>/?1234567890")]
    texts += ["Быстрая коричневая лиса прыгает через ленивую собаку", "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί", "敏捷的棕色狐狸跳过了懒狗然后跑进了森林", "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee metsään jossa muut eläimet asuvat"]
    # Without a stated language, so that no fit reads them.
    foreign = spark.createDataFrame([(10_000_000 + i, t, None, "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages.language(spark, docs.select(*stages.COLUMNS).unionByName(foreign), "").select("doc_id", "lang").collect()
    assert not [r.doc_id for r in kept if r.doc_id >= 10_000_000]
    stated = {r.doc_id: r.lang for r in docs.where(F.col("text").rlike("\\p{L}") & F.col("lang").isNotNull()).collect()}
    assert sum(r.doc_id in stated for r in kept) >= 0.98 * len(stated)
    assert sum(stated.get(r.doc_id) == r.lang for r in kept) >= 0.98 * len(kept)
    # French, where only the others are learned.
    unlearned = docs.select(*stages.COLUMNS).withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    passed = stages.language(spark, unlearned, "").select("doc_id").collect()
    french = {i for i, x in stated.items() if x == "fr"}
    assert sum(r.doc_id in french for r in passed) <= 0.05 * len(french)


def test_language_stage_keeps_texts_in_two_learned_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*stages.COLUMNS)
    rows = docs.where("lang is not null and n_chars between 800 and 3000").orderBy("doc_id").limit(60).collect()
    mixed = [(20_000_000 + i, a.text + "\n" + b.text, None, "s", 0) for i, (a, b) in enumerate(zip(rows, rows[1:])) if a.lang != b.lang]
    both = docs.unionByName(spark.createDataFrame(mixed, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = stages.language(spark, both, "").where("doc_id >= 20000000").count()
    assert len(mixed) > 10 and kept >= 0.95 * len(mixed)


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randint(0, 999)}" for _ in range(80))
    a, b, c = text(), text(), text()
    near = a.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (1, a), (1, c), (2, near), (3, a), (4, b), (None, a), (None, a), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0), r.text or "") for r in stages.near_duplicates(spark, docs, "").collect())
    assert got == sorted([(1, a), (1, c), (4, b), (0, a), (0, a), (5, ""), (6, "")])


def test_line_stage_and_token_stage(spark):
    rows = [(i, f"own {i}\n{LINE}") for i in range(6)] + [(7, None), (8, ""), (9, f"x ▁\t{LINE}")]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in stages.lines(spark, docs, "").collect()}
    assert got == {**{i: (f"own {i}", 5) for i in range(5)}, 5: (f"own 5\n{LINE}", 6 + len(LINE)), 7: ("", 0), 8: ("", 0), 9: (rows[-1][1], 4 + len(LINE))}
    out = {r.doc_id: (r.n_chars, r.decoded_sha256) for r in stages.tokens(spark, docs, "").collect()}
    assert out == {i: (len(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_held_out_rows_of_the_fitted_queries(spark):
    """Toxicity and language ID by their queries: rows held out by crc32 are never learned from, and are got right."""
    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = langid.op3_language_id(spark, sf).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    stated = [r for r in held if docs[r.doc_id].lang is not None]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in stated) >= 0.985 * len(stated)
    out = toxicity.op1_toxicity(spark, sf).collect()
    assert len(out) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in out)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    pairs = [(r.predicted, toxic[r.doc_id]) for r in out if r.held_out and toxic.get(r.doc_id) is not None]
    caught, bad, said = sum(p and t for p, t in pairs), sum(t for _, t in pairs), sum(p for p, _ in pairs)
    assert caught >= 0.85 * bad and caught >= 0.95 * said


def test_near_duplicates_of_hot_classes_and_bare_rows(spark):
    rng = random.Random(11)
    text = lambda: " ".join(f"w{rng.randint(0, 999)}" for _ in range(80))
    a, b = text(), text()
    near = a.rsplit(" ", 1)[0] + " changed"
    # A third of the rows are copies of one text; one of these ids has a second text, and others rows without words.
    rows = [(i, a) for i in range(100, 160)] + [(i, text()) for i in range(200, 320)] + [(7, near), (130, b), (3, b), (140, ""), (141, None), (2, " "), (None, a), (None, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85, bands=24).collect())
    joined = {*range(100, 160), 7, 3}
    size = lambda t: len({tuple((t or "").split()[k : k + 3]) for k in range(78)}) if (t or "").strip() else 0
    assert got == sorted((i or 0, size(t), 3 if i in joined else i or 0, i is None or i not in joined or i == 3) for i, t in rows)
