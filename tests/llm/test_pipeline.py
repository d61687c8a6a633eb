"""What each stage of the pipeline must keep, computed in plain Python on a small table with planted cases."""

import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import langid

WORDS = {"en": "the house of a man with his dog near that old river and some small trees they saw".split(),
         "de": "das haus und der hund mit dem mann ist schön am alten fluss wo kleine bäume stehen".split(),
         "fr": "la maison avec le chien et les hommes où être près de la vieille rivière sous des arbres".split()}
ITEM = "seven copper kettles were sold at noon beside the harbour for less than a sailor would pay in spring"


def table(spark, tmp_path):
    rng, rows = np.random.default_rng(1), []
    for k in range(90):
        lang = list(WORDS)[k % 3]
        rows.append((k, " ".join(rng.choice(WORDS[lang], 60 + k % 7)), lang, "abc"[k % 3]))
    texts = {k: t for k, t, *_ in rows}
    rows += [(100, texts[10], "de", "a"), (101, texts[10] + " ende", "de", "b"), (102, texts[20].replace("chien", "chat", 1), "fr", "c"),
             (110, texts[30] + " " + ITEM + " " + texts[33], "en", "a"), (111, texts[36] + " " + ITEM.replace("noon", "dusk"), "en", "b"),
             (120, "12 34 !?", "en", "a"), (121, None, "en", "b"), (122, "", None, None), (123, "%%% --- 99", "de", "c")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "own", 1.5, True) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, ambiguous boolean")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "an item that stands nowhere in any of these texts at all")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    return docs, rows


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower() if text else "")
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_every_stage_keeps_what_it_must(spark, tmp_path):
    docs, rows = table(spark, tmp_path)
    stage, at = dict(corpus_pipeline.STAGES), str(tmp_path)
    first = docs
    # language: what has no letter goes, clean texts stay, and columns keep their own values
    docs = stage["language ID"](spark, docs, at).checkpoint()
    told = {r["doc_id"]: r for r in docs.collect()}
    assert set(told) == {r[0] for r in rows} - {120, 121, 122, 123} and docs.columns == first.columns
    assert {(r["lang_pred"], r["score"], r["ambiguous"]) for r in told.values()} == {("own", 1.5, True)}
    # near duplicates: the smallest id of each group
    sets = {i: shingles(r["text"]) for i, r in told.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    docs = stage["MinHash near-dedup"](spark, docs, at).checkpoint()
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {i for i, r in root.items() if i == r} and {100, 101, 102}.isdisjoint(kept) and docs.columns == first.columns
    # decontamination: those two hold the item
    docs = stage["benchmark decontamination"](spark, docs, at).checkpoint()
    clean = {r["doc_id"]: r for r in docs.collect()}
    assert set(clean) == kept - {110, 111} and docs.columns == first.columns
    # mixing: whole documents, up to three times and one more, near the targets
    sizes = {i: len(r["text"].split()) for i, r in clean.items()}
    by_source = {s: sum(n for i, n in sizes.items() if clean[i]["source"] == s) for s in "abc"}
    weights, total = dict(a=5, b=2, c=1), sum(sizes.values())
    target, open_ = {}, set(weights)
    while True:
        left = total - sum(target.values())
        over = {s for s in open_ if left * weights[s] / sum(weights[x] for x in open_) > 3 * by_source[s]}
        if not over:
            break
        target |= {s: 3 * by_source[s] for s in over}
        open_ -= over
    target |= {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
    docs = stage["mixing sources to target weights"](spark, docs, at).checkpoint()
    taken = [r.asDict() for r in docs.collect()]
    assert docs.columns == first.columns and all(r == clean[r["doc_id"]].asDict() for r in taken)
    for s in "abc":
        assert abs(sum(sizes[r["doc_id"]] for r in taken if r["source"] == s) - target[s]) <= max(sizes.values()) / 2
    # tokens: the ids of the tokenizer, one document behind the other
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER)), 0
    got = stage["token-ID / binary output"](spark, docs, at).orderBy("start").collect()
    for r, want in zip(got, sorted(taken, key=lambda r: (r["doc_id"], r["text"])), strict=True):
        ids = np.array([*tokenizer.encode(want["text"], add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (want["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    # all stages in a row give the same
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect())) == sorted(map(tuple, got))
    assert langid.UNDETERMINED == "und" and first.select(F.max("doc_id")).first()[0] == 123
