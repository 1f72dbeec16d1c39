"""Every stage against a plain version of its decision, and the whole run."""

import numpy as np
from test_near_copies import plain_kept
from test_packing_and_search import check_pieces

import corpus_pipeline as C
from wattledger.llm import quality as Q
from wattledger.llm import secrets as S
from wattledger.llm.common import table, written
from wattledger.llm.queries import tokenizer_file


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")


def windows(text):
    words = [w for w in plain_words(text) if w]
    return {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))} if words else set()


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    documents, names = table(spark, folder, "documents"), [n for n, _ in C.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    stages = dict(C.STAGES)

    good = written(stages["quality"](spark, documents, folder))
    trees = Q.fit_quality(documents, table(spark, folder, "labels"))
    before = documents.collect()
    chance = trees.probability(np.array([Q.statistics(r.text) for r in before]))
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r, p in zip(before, chance, strict=True) if p >= 0.3)

    single = written(stages["near_duplicates"](spark, good, folder))
    assert sorted(r.doc_id for r in single.collect()) == plain_kept([(r.doc_id, r.text) for r in good.collect()])

    items = [(len(w), w) for r in table(spark, folder, "benchmark").collect() for w in windows(r.text)]
    clean = written(stages["decontamination"](spark, single, folder))

    def leaks(text):
        words = [w for w in plain_words(text) if w]
        own = {n: {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} for n in {n for n, _ in items}}
        return any(w in own[n] for n, w in items)

    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect() if not leaks(r.text))

    masked = written(stages["secrets"](spark, clean, folder))
    assert {r.doc_id: r.text for r in masked.collect()} == {r.doc_id: S.mask(r.text) for r in clean.collect()}
    for df in (good, single, clean, masked):
        assert df.schema.names == documents.schema.names

    tokenizer = Tokenizer.from_file(tokenizer_file())
    pieces = stages["packing"](spark, masked, folder).collect()
    kept = [(r.doc_id, r.text) for r in masked.collect()]
    check_pieces(pieces, kept, lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4"))

    whole = C.run(spark, folder).collect()
    assert sorted(map(str, whole)) == sorted(map(str, pieces))
