import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_decide(spark, tmp_path):
    story = " ".join(f"the story of number {i} and its word{i}" for i in range(40))
    copy = story.replace("word7", "other").replace("number 21", "nothing else")
    item = "what is the name of the river that runs past this old town today"
    rows = [
        (1, story, "en", "s", 1, "a"), (2, copy, None, "s", 1, "b"), (3, "12345 !!", "en", "s", 1, "c"), (4, None, "en", "s", 1, "d"), (5, f"one more text\n{item}\nand the end", "en", "s", 1, "e"),
        (6, "a line that many documents do share\nthe first text that is only here", "en", "s", 1, "f"), (7, "a line that many documents do share\nand the second one of this text", "en", "s", 1, "g"),
        (8, "a line that many documents do share", "en", "s", 1, "h"), (9, "der erste deutsche text und die zeile darin", "de", "s", 1, "i"), (9, "der erste deutsche text und die zeile darin", "de", "s", 1, "i"),
        *[(20 + i, f"the text and the words of document {i} in the list", "en", "s", 1, "j") for i in range(12)], *[(40 + i, f"der text und die worte von dokument {i} in der liste", "de", "s", 1, "k") for i in range(12)],
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert not {3, 4} & set(seen["language_id"]) and seen["language_id"][2].lang == "en"
    assert 8 not in seen["line_dedup"] and seen["line_dedup"][7].text == "and the second one of this text" and seen["line_dedup"][7].n_chars == len("and the second one of this text")
    assert {1, 2} <= set(seen["line_dedup"]) and 1 in seen["near_dedup"] and 2 not in seen["near_dedup"]
    assert 5 in seen["near_dedup"] and 5 not in seen["decontamination"] and {1, 6, 7, 9} <= set(seen["decontamination"])
    tokens = seen["bpe"]
    texts = seen["decontamination"]
    assert set(tokens) == set(texts)
    assert all(t.decoded_sha256 == hashlib.sha256(texts[i].text.encode()).hexdigest() and t.n_tokens == len(t.ids) for i, t in tokens.items())


def test_documents_in_no_learnt_language_go(spark, small):
    from tvloom.llm import stages

    rng = random.Random(1)
    consonants = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(120))
    hexes = " ".join("%032x" % rng.getrandbits(128) for _ in range(40))
    others = ["Это обычный русский текст о погоде и о городе, в котором мы живём. " * 5, "这是一个关于城市和天气的普通中文文本" * 5, "To jest zwykły polski tekst o pogodzie i o mieście. " * 5, consonants, hexes]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(others)], "doc_id long, text string, lang string").select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    kept = {r.doc_id for r in stages.identify_language(spark, docs.union(more), small).collect()}
    assert kept == {r.doc_id for r in docs.where(docs["text"].rlike(r"\p{L}")).collect()}


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert 0 < len(rows) <= 200 and all(r.n_tokens > 0 for r in rows)


def test_run_against_brute_force(spark, tmp_path):
    """The five stages one by one in plain Python, on documents with repeated and nearly repeated lines, near copies and leaks.

    Which of a class of near copies stays isn't said, so one of each class has to be there.
    """
    import public_tokenizers as P
    import tiktoken
    from test_decontam import brute as brute_items
    from test_line_dedup import brute as brute_lines
    from test_near_dedup import plain_shingles, similar

    from tvloom.llm import bpe, langid, line_dedup, stages

    rng = random.Random(8)
    english = "the of and to in that is was for with his they have from this when word there been which".split()
    german = "der die und das ist nicht mit sich auf ein eine dem den von wird auch noch nach einer über".split()
    bench = [(1, " ".join(f"secret{i} of the" for i in range(8))), (2, "kurze frage"), (3, None)]

    def line(words):
        return " ".join(rng.choice(words) + rng.choice(["", "s", "en", str(rng.randrange(30))]) for _ in range(rng.randint(4, 16)))

    common = [line(english) for _ in range(3)] + [line(german)]
    docs = []
    for i in range(60):
        words, lang = (english, "en") if i % 3 else (german, "de")
        lines = [line(words) for _ in range(rng.randint(3, 7))]
        if i % 5 == 0:
            lines.insert(rng.randrange(len(lines)), rng.choice(common))
        if i % 7 == 0:  # a line within the edits of a common one
            lines.append(rng.choice(common).replace("e", "x", 1))
        if i % 11 == 0:
            lines.append("so " + bench[0][1] + " so")
        if i % 13 == 0:
            lines += ["", "so eine kurze frage hier am rande gestellt"]
        docs.append((i, "\n".join(lines), lang if i % 4 else None))
    for i in range(10):  # near copies as wholes: each line is beyond the edits, as words change place with others
        words = docs[i][1].replace("\n", " ").split() * 3
        docs[i] = (i, " ".join(words), docs[i][2])
        words[4], words[-3] = "andere", "other"
        docs.append((100 + i, " ".join(["quite", "new", "words", "here", "eight"] + words), docs[i][2]))
    docs += [(200, None, "en"), (201, "", "de"), (202, "123 !!", "en"), (203, common[0], "en"), (204, common[0], "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    lettered = [(i, t, lang) for i, t, lang in docs if t and any(c.isalpha() for c in t)]
    learnt = sorted({(t, lang) for i, t, lang in lettered if lang and zlib.crc32(str(i).encode()) % 3 != 1}, key=lambda r: r[1])
    model = langid.Model.fit(learnt)
    scores = model.predict([t for _, t, _ in lettered])[1]
    assert all(abs(s - stages.LEAST_SCORE) > 1e-3 for s in scores)
    kept = {i: t for (i, t, _), s in zip(lettered, scores) if s >= stages.LEAST_SCORE}

    dropped = brute_lines(list(kept.items()), line_dedup.STEP, line_dedup.MOST)
    texts = {}
    for i, t in kept.items():
        lines = t.split("\n")
        if any(line.strip() and (i, t, n) not in dropped for n, line in enumerate(lines)):
            texts[i] = "\n".join(line for n, line in enumerate(lines) if (i, t, n) not in dropped)
    assert dropped and len(texts) < len(kept)

    pieces = {i: plain_shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and pieces[i] and pieces[j] and set(pieces[i]) & set(pieces[j]) and similar(pieces[i], pieces[j]):
                old, new = root[j], root[i]
                root = {k: new if r == old else r for k, r in root.items()}
    classes = {}
    for i, r in root.items():
        classes.setdefault(r, set()).add(i)
    assert sum(len(c) > 1 for c in classes.values()) > 5

    leaked = {i for i, t in texts.items() if brute_items(t, bench)[1]}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    for members in classes.values():
        assert members <= leaked or not members & leaked
        assert len(members & set(rows)) == (0 if members & leaked else 1), members
    assert leaked and set(rows) <= set(texts)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    for i, r in rows.items():
        assert r.ids == theirs.encode_ordinary(texts[i]) and r.n_tokens == len(r.ids)
