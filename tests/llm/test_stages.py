"""Every pipeline stage on empty tables, null rows and columns whose names clash with its own."""

import pytest

import corpus_pipeline

EXTRA = ["found_lang", "found_score", "size", "key", "copies", "copies_of", "token_ids", "component_id", "n_shingles", "spans", "row", "check", "taken", "target"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def rows():
    texts = [(1, "the house and the river and the mill"), (2, "das haus und der fluss und die mühle"), (3, "the house and the river and the mill"), (4, None), (5, ""), (6, "write to anna@example.org or 192.168.0.1 now"), (None, "the forest and the mill"), (7, "12 34")]
    return [(i, t, "en" if t and "the" in t else "de" if t and "das" in t else None, None if i == 2 else "s", None if t is None else len(t), *("x" for _ in EXTRA)) for i, t in texts]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage(spark, stage):
    name, run = stage
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = run(spark, docs, "")
    found = out.collect()
    if name == "encoding":
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"] and len(found) == len(rows())
        assert all((r.n_tokens == 0) == (r.doc_id in (4, 5)) for r in found)
    else:
        assert out.columns == docs.columns and all(r.component_id == "x" and r["size"] == "x" for r in found)
        ids = [r.doc_id for r in found]
        if name == "language":
            assert sorted((i is None, i or 0) for i in ids) == [(False, 1), (False, 2), (False, 3), (False, 6), (True, 0)]
        elif name == "near duplicates":
            assert 3 not in ids and {1, 2, 4, 5, 6, 7, None} == set(ids)
        elif name == "personal data":
            assert "anna@example.org" not in next(r.text for r in found if r.doc_id == 6) and len(found) == len(rows())
        else:
            assert not {4, 5} & set(ids) and max(ids.count(i) for i in ids) <= 3
    none = run(spark, docs.limit(0), "")
    assert none.count() == 0 and none.columns == out.columns
