"""The pipeline's stages against plain versions, each on what the stage before kept."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from lexispark.llm import token_files as tf
from lexispark.llm.line_quality import fit_quality
from lexispark.llm.shared import materialize

from test_jaccard_join import plain as plain_components
from test_native import plain_hits, water

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.documents(spark, SF)
    rows = {0: docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        rows[k + 1] = out.collect()
        if k < 4:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows[k + 1], docs.schema)
    model = fit_quality(corpus_pipeline.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"))
    good = model.scores([r.text or "" for r in rows[0]]) >= 0.3
    assert sorted(r.doc_id for r in rows[1]) == sorted(r.doc_id for r, g in zip(rows[0], good) if g)
    leaders = {c for _, n, c in plain_components([(r.doc_id, r.text) for r in rows[1]]) if n}
    assert sorted(r.doc_id for r in rows[2]) == sorted(leaders | {r.doc_id for r in rows[1] if not (r.text or "").split()})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in rows[3]) == sorted(r.doc_id for r in rows[2] if not plain_hits(r.text, items)[3])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, longest = defaultdict(int), Counter(), Counter()
    for r in rows[3]:
        sizes[r.source] += size(r.text)
        longest[r.source] = max(longest[r.source], size(r.text))
    for r in rows[4]:
        taken[r.source] += size(r.text)
    assert max(Counter(r.doc_id for r in rows[4]).values()) <= 3 and {r.doc_id for r in rows[4]} <= {r.doc_id for r in rows[3]}
    for source, target in water(sizes).items():
        assert abs(taken[source] - target) <= longest[source]
    encoder, start = tf.Encoder(tf.default_tokenizer()), 0
    got = iter(sorted(rows[5], key=lambda r: r.start))
    for r in sorted(rows[4], key=lambda r: (r.doc_id, r.text)):
        ids = [*encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        out = next(got)
        assert (out.doc_id, out.start, out.n_tokens, out.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)


def write_tables(spark, folder, docs, schema, items, labels):
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_cases(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, start long, copies int, component_id long"
    rng = random.Random(4)
    text = lambda n: " ".join("w" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    clash = (0.5, 7, 8, 9, 10)
    docs = [(i, text(30), "en", f"s{i % 3}", 1, *clash) for i in range(40)]
    docs += [(40, docs[3][1], "en", "s0", 1, *clash), docs[5], docs[5]]
    docs += [(41, text(20_000), None, None, None, None, None, None, None, None), (42, "", "en", "s1", 0, *clash), (None, None, None, None, None, *clash), (43, None, "en", "s1", None, *clash)]
    item = text(13)
    docs.append((44, item, "en", "s2", 1, *clash))
    write_tables(spark, f"{tmp_path}/t", docs, schema, [(1, item), (None, None), (2, "")], [(i, 1, 0) for i in range(40)] + [(None, None, None)])
    left, sizes = corpus_pipeline.documents(spark, f"{tmp_path}/t"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = left.columns
        left, _ = materialize(stage(spark, left, f"{tmp_path}/t"), name)
        rows = left.collect()
        assert left.columns == columns and all(tuple(r) in docs for r in rows)
        sizes[name] = Counter(r.doc_id for r in rows)
    assert sizes["quality"] == Counter(d[0] for d in docs)
    assert sizes["near_duplicates"].keys() == sizes["quality"].keys() - {40} and sizes["near_duplicates"][5] == 1
    assert sizes["decontamination"] == sizes["near_duplicates"] - Counter([44])
    out = corpus_pipeline.run(spark, f"{tmp_path}/t").collect()
    assert Counter(r.doc_id for r in out) == sizes["mixture"] and min(r.n_tokens for r in out) >= 1
    assert [r.start for r in sorted(out, key=lambda r: r.start)][0] == 0


def test_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long", [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
