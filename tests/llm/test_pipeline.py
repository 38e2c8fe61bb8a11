"""The pipeline, held against each operator's parts applied one after the other by brute force."""

import random
from collections import defaultdict
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from lamina.llm import quality_rules, secret_scan, toxicity
from lamina.llm.packing import CAPACITY, tokens_of, two_fit
from lamina.llm.queries import ORACLES, QUERIES

from . import edges

HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9)))
    docs, labels, texts = [], [], []
    for i in range(1600):
        kind = i % 8
        text = " ".join(word() for _ in range(r.randint(30, 120)))
        if kind == 0:
            text = " ".join(w + "$$$" for w in text.split())
        elif kind == 1:
            text += ". What an idiot wrote that"
        elif kind == 2 and i > 100:
            text = " ".join(word() if r.random() < 0.03 else w for w in texts[i - 5].split())
        elif kind == 3:
            text += f' token = "{HEX}" end'
        texts.append(text)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(kind != 0), int(kind == 1)))
    docs += [(None, None, 'en', 's', 1), (2000, '', 'en', 's', 0), (2001, 'longer text ' + ' '.join(word() for _ in range(9000)), 'en', 's', 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    edges.documents(spark, docs).write.parquet(f"{folder}/documents.parquet")
    edges.labels(spark, labels).write.parquet(f"{folder}/labels.parquet")
    return folder, docs, labels


def test_stages(spark, corpus):
    folder, docs, labels = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity_grammar", "simhash_forest", "multipart_secrets", "best_two_fit"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = now.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == columns, name
        kept.append(now.collect())
        now = spark.createDataFrame(kept[-1], now.schema)
    marks = {d: (q, t) for d, q, t in labels}
    docs = [d for d in docs if d[2] == "en"]
    shares = quality_rules.shares(pa.array([t for _, t, *_ in docs]))
    cutoffs = quality_rules.choose(quality_rules.measured(spark.read.parquet(f"{folder}/documents.parquet")), spark.read.parquet(f"{folder}/labels.parquet"))["en"]
    first = {d for i, (d, t, *_) in enumerate(docs) if t and t.strip() and all(shares[n][i] <= c for n, c in cutoffs.items())}
    assert not any(marks[d][0] == 0 for d in first if d in marks) and len(first) > 1350
    assert {r.doc_id for r in kept[0]} == first
    lexicon = toxicity.learn(spark.createDataFrame(kept[0], spark.read.parquet(f"{folder}/documents.parquet").schema), spark.read.parquet(f"{folder}/labels.parquet"))
    second = {d for d, t, *_ in docs if d in first and toxicity.score_text(t, lexicon)[0] < 1}
    assert {r.doc_id for r in kept[1]} == second and all(marks.get(d, (1, 0))[1] == 0 for d in second)
    copies = {i for i in second if i is not None and i < 1600 and i % 8 == 2 and i > 100 and i - 5 in second}
    third = {r.doc_id for r in kept[2]}
    assert second - copies <= third <= second and len(third & copies) <= 0.02 * len(copies) and len(copies) > 100
    assert all(HEX not in r.text for r in kept[3]) and {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[2]}
    assert sum("[assigned]" in r.text for r in kept[3]) == sum(HEX in r.text for r in kept[2]) > 100
    assert {r.text for r in kept[3] if "[" not in r.text} <= {r.text for r in kept[2]}
    parts = []
    for r in kept[3]:
        size = len(tokens_of(r.text)) + 1
        parts += [(r.doc_id, k, min(CAPACITY, size - k * CAPACITY)) for k in range(-(-size // CAPACITY))]
    parts.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    want = sorted(sorted((parts[i] for i in b), key=str) for b in two_fit([n for *_, n in parts], CAPACITY))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.bin_id].append((r.doc_id, r.piece, r.length))
    assert sorted(sorted(b, key=str) for b in got.values()) == want


def test_stages_bear_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns: what each stage says of them."""
    edges.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = edges.documents(spark).cache()
    ids = lambda df: sorted((-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect()))
    want = {"quality_rules": [-1, 1, 1, 5, 6, 7, 8], "toxicity_grammar": ids(docs), "simhash_forest": [-1, -1, 1, 2, 3, 4, 5, 6, 7, 8], "multipart_secrets": ids(docs)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and ids(got) == want[name], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {None, 1, 3, 4, 5, 6, 7, 8}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_only_the_last_result_stays(spark, corpus):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.glob("pipeline-*/*"))
    assert corpus_pipeline.run(spark, corpus[0]).count() > 0
    assert [x.name for x in set(root.glob("pipeline-*/*")) - before] == ["4-best_two_fit"]


def test_empty_corpus(spark, tmp_path):
    edges.documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    edges.labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(names)
    assert secret_scan.findings and "pipeline" not in __spark_entry__.oracle_sql()
