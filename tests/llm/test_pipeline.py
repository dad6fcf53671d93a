from collections import Counter

import corpus_pipeline
from siftql.llm import bag_minhash, mixing, quality_rules, secret_scan
from siftql.llm._shared import read_table
from tests.llm.test_near_duplicates import brute_near
from tests.llm.test_quality_and_mix import WORD, brute_rules


def test_stages_do_what_brute_force_does(spark, sf):
    docs = read_table(spark, sf, "documents")
    good = corpus_pipeline.quality(spark, docs, sf)
    want = []
    for r in docs.collect():
        n, chars, symbols, dup, repeat = brute_rules(r.text)
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        upper = sum("A" <= c <= "Z" for c in r.text or "")
        if not (n < 50 or 100 * repeat > 50 * n or 4 * symbols > n or 2 * upper > chars or 2 * dup > len(lines) or not 2 * n <= chars <= 25 * n):
            want.append(r)
    assert sorted(good.collect()) == sorted(want) and good.columns == docs.columns
    one = corpus_pipeline.deduplicate(spark, good, sf)
    near = brute_near([(r.doc_id, r.text) for r in want])
    want = [r for r in want if near[r.doc_id] == r.doc_id]
    assert sorted(one.collect()) == sorted(want)
    safe = {r.doc_id: r for r in corpus_pipeline.secrets(spark, one, sf).collect()}
    assert safe.keys() == {r.doc_id for r in want}
    for r in want:
        spans = secret_scan.scan_text(r.text, dictionary=corpus_pipeline.DICTIONARY)[1]
        assert safe[r.doc_id].text == secret_scan.redact(r.text, spans)
    mixed = corpus_pipeline.mix(spark, one, sf)
    times = Counter(r.doc_id for r in mixed.collect())
    taken = {r.doc_id: r.taken / max(r.size, 1) for r in mixing.mix(one).collect()}
    assert mixed.columns == docs.columns and all(abs(times[i] - t) < 1 for i, t in taken.items())


def test_run_and_odd_rows(spark, sf, odd):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = odd.select("doc_id", "text", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "source", "n_chars"]
    assert quality_rules.DEFAULT.version == "v2" and bag_minhash.THRESHOLD == 0.8
