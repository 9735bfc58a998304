"""The pipeline against a plain version of it, on a small table."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import WORD, brute_components, brute_targets, languages, near_copies, prose

from tessella.llm import packing
from tessella.llm.common import staged


def test_stages_and_run(spark, make, tmp_path):
    rng = random.Random(21)
    rows = languages(rng, 60)
    base = prose(rng, 60, "abcde")
    for k, t in enumerate([base, base, base.replace(" ", "\t"), *near_copies(rng, base, 5, 2)]):
        rows.append((100 + k, t, "aa", "hot"))
    rows += [(200, "123 456", "aa", "s"), (201, None, "aa", "s")]
    folder = tmp_path / "sf"
    make(rows).write.parquet(str(folder / "documents.parquet"))

    docs = spark.read.parquet(str(folder / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, str(folder)), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id: r.text for r in docs.collect()})
    with_letters = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert set(seen[0]) <= set(with_letters) and len(seen[0]) >= 0.95 * len(with_letters)
    groups = defaultdict(list)
    for i, t in sorted(seen[0].items()):
        groups[" ".join(WORD.findall(t))].append(i)
    assert set(seen[1]) == {g[0] for g in groups.values()}
    assert set(seen[2]) == {i for i, (_, c) in brute_components(sorted(seen[1].items())).items() if c == i}
    assert set(seen[3]) <= set(seen[2])

    got = corpus_pipeline.run(spark, str(folder)).collect()
    counts = Counter(r.doc_id for r in docs.collect())
    assert Counter(r.doc_id for r in got if r.piece == 0) == counts
    # a document that the mix takes twice is packed twice: each of its pieces occurs as often, with the same ids
    path = packing.vocabulary_path()
    tokens = Tokenizer.from_file(path)
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = Counter()
    for i, text in seen[3].items():
        ids = [*tokens.encode(text, add_special_tokens=False).ids, 2]
        first = len(ids) - (len(ids) - 1) // 1024 * 1024
        for k, at in enumerate([0, *range(first, len(ids), 1024)]):
            cut = ids[at : first if k == 0 else at + 1024]
            want[i, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += counts[i]
    assert pieces == want
    # the mix: every source's words near its target, no document more than twice
    sizes = {i: len(WORD.findall(t)) for i, t in seen[2].items()}
    sources = {r[0]: r[3] for r in rows}
    by_source = Counter()
    for i, n in sizes.items():
        by_source[sources[i]] += n
    took = Counter()
    for i, n in counts.items():
        assert n <= 2
        took[sources[i]] += n * sizes[i]
    for source, target in brute_targets(by_source).items():
        assert abs(took[source] - target) <= max(sizes.values())
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, size in sorted(p):
            assert offset == end
            end += size
        assert end <= 1024


def test_odd_and_empty_tables(spark, odd, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns through all stages; then no rows at all."""
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        stage_docs = spark.read.parquet(str(folder / "documents.parquet"))
        for label, stage in corpus_pipeline.STAGES[:-1]:
            stage_docs = staged(stage(spark, stage_docs, str(folder)), "test")
            assert stage_docs.columns == odd.columns, label
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r.doc_id for r in got} == {r.doc_id for r in stage_docs.collect()} and (name == "odd") == bool(got)
