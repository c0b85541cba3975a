"""Columns to keep whose names operators might use themselves."""

import public_tokenizers as P
import pytest

from tvloom.llm import bpe, html_extract, langid, pii

NAMES = ["__text", "__html", "__slot", "__constant", "__ids", "kept", "ids_", "slot"]


@pytest.fixture
def named(odd):
    return odd.selectExpr("doc_id", "text", "lang", "text as url", *[f"concat('{n}', doc_id) as `{n}`" for n in NAMES])


def kept(df):
    rows = df.collect()
    assert len(rows) > 5
    for r in rows:
        assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in NAMES)


def test_names(named):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.encode(named, path, P.PATTERN, keep=["doc_id", *NAMES], outputs=["ids"])
    kept(tokens)
    kept(bpe.decode(tokens, path, P.PATTERN, keep=["doc_id", *NAMES]))
    kept(langid.predict(named, langid.fit(named, named["doc_id"].isNotNull()), keep=["doc_id", *NAMES]))
    kept(html_extract.extract(named.withColumnRenamed("text", "html"), keep=["doc_id", *NAMES]))


@pytest.mark.parametrize("name", ["__id", "__t", "__text", "spans", "clean_text"])
def test_refused_names(odd, name):
    with pytest.raises(ValueError):
        pii.find(odd.withColumnRenamed("h", name), keep=["doc_id", name])
