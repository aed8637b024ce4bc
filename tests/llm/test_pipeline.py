"""The pipeline's stages on planted cases, and the registration of the queries."""

import zlib

import corpus_pipeline
from gridloom.llm.queries import QUERIES, SQL
from tests.llm.conftest import speak

SF = "/root/testdata/sf0.01"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_catch_planted_cases(llm, tmp_path):
    real = llm.read.parquet(f"{SF}/documents.parquet")
    bench = llm.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    own = 10_000_000
    clean = [(own + i, ". ".join(speak(own + 31 * i + j, 25) for j in range(6)) + ".", "en", "planted", 0) for i in range(5)]
    copy = [(own + 100, clean[0][1], "en", "planted", 0), (own + 101, clean[1][1] + " tail", None, None, None)]
    leak = [(own + 200, speak(own + 5000, 60) + " " + bench, "en", "planted", 0)]
    junk = [(own + 300, ("BUY!! NOW!! CHEAP!! " * 80).strip(), "en", "planted", 0)]
    docs = real.unionByName(llm.createDataFrame(clean + copy + leak + junk, DOCUMENT))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm, docs, SF)
        assert out.columns == real.columns
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        docs = llm.read.parquet(path)
        seen[name] = {r["doc_id"] for r in docs.where(f"doc_id >= {own}").select("doc_id").collect()}
    names = list(seen)
    assert own + 300 not in seen[names[0]] and {c[0] for c in clean} <= seen[names[0]]
    assert own + 100 not in seen[names[2]] and own + 101 not in seen[names[2]]
    assert own + 200 in seen[names[2]] and own + 200 not in seen[names[3]]
    assert {c[0] for c in clean} <= seen[names[3]]
    mixed = corpus_pipeline.STAGES[-1][1](llm, docs, SF).collect()
    assert mixed and all(r["taken"] > 0 for r in mixed)


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert set(SQL) <= set(QUERIES) and zlib.crc32(b"1") % 10 is not None


def test_odd_tables_pass_every_stage(messy, nothing, llm, tmp_path):
    llm.createDataFrame([(4, 1, 0), (5, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    llm.createDataFrame([(1, "nothing of it"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(llm, nothing, str(tmp_path)).count() == 0
        out = stage(llm, messy, str(tmp_path))
        assert out.count() <= messy.count()
