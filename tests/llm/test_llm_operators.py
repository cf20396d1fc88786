"""Every operator against a plain version, over odd rows: nulls, empty and long texts, ties, clashing columns."""

from __future__ import annotations

import random
import re
import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer as Library

from tidewell.llm import bpe, counting, lines, lm, minhash, packing, planes, quality, shards, tokens, vectors
from tidewell.llm.common import process_store
from tidewell.llm.components import components
from tidewell.llm.tokens import Tokenizer, inside_pairs

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
WORDS = "the of and stone river Light mountain a 12 over, under. été 中文 ΣΟΣ it's <|endoftext|>".split()
PARTS = "an be or tion ing the of her es ti re on ver al dis pro com sub inter".split()
#: Columns whose names the operators make themselves.
CLASH = ["ids", "N_TOKENS", "shard", "kept", "n_lines", "component_id", "row", "key", "part", "n_links", "score"]


def prose(rng: random.Random, words: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(words))


def odd_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, prose(rng, 30_000)), (5, "a b c"), (5, "a b c"), (None, "x y z"), (None, None)]
    rows += [(6, "x" * 70_000), (7, "\n" * 500 + "end"), (8, "\U0001f600 \x00 \x1f é  　 z")]
    rows += [(100 + i, prose(rng, rng.randint(1, 400))) for i in range(40)]
    rows += [(200 + i, rows[-1 - i][1]) for i in range(5)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    fields = ", ".join(f"`{c}` string" for c in CLASH)
    rows = [(i, t, *["z" if i == 5 else None] * len(CLASH)) for i, t in odd_texts()]
    spark.createDataFrame(rows, f"doc_id bigint, text string, {fields}").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(odd, tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    odd.where("doc_id = -1").write.parquet(path)
    return spark.read.parquet(path)



def test_fragments_equal_the_library():
    rng = random.Random(1)
    signs = [*WORDS, " ", "  ", "\n", "\t", "'s", "'LL", "é", "é", "Σ", "#", "_", "²", "’", "\x1f", "ǅ", "\xa0", "."]
    texts = [t or "" for _, t in odd_texts()] + ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(2000)]
    for path in (BYTE, WORD):
        tokenizer = Tokenizer(open(path, encoding="utf-8").read())
        tokenizer.digest = path
        assert tokenizer.ranks is not None and tokenizer.certain.any()
        for text in texts:
            want = tokenizer.library.encode(text, add_special_tokens=False).ids
            for least in (1, 64, 4096):
                assert tokenizer.encode_parts(text.encode(), least).tolist() == want, text[:60]
            if path == BYTE:
                ids = np.array(want, dtype=np.uint32)
                assert tokenizer.decode(ids) == tokenizer.library.decode(want, skip_special_tokens=False)


def test_batches_equal_the_library_and_run_the_ranks_once(monkeypatch):
    rng = random.Random(4)
    texts = [t or "" for _, t in odd_texts()] + [prose(rng, 50).translate({0x3A3: None, 0x3C: None}) for _ in range(40)]
    for path in (BYTE, WORD):
        tokenizer = Tokenizer(open(path, encoding="utf-8").read())
        tokenizer.digest = f"batches of {path}"
        for own in (texts, texts[::-1], [""], []):
            ids, sizes = tokenizer.encode_batch([t.encode() for t in own], 1 << 16)
            want = [tokenizer.library.encode(t, add_special_tokens=False).ids for t in own]
            assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))
    tokenizer.digest, calls, ranks = "a new cache", [], tokenizer.ranks

    class Counting:
        def encode_to_numpy(self, text, **options):
            calls.append(text)
            return ranks.encode_to_numpy(text, **options)

    tokenizer.ranks = Counting()
    own = [" ".join(f"{a}{b}." for a in PARTS for b in rng.sample(PARTS, 9)) for _ in range(20)]
    ids, sizes = tokenizer.encode_batch([t.encode() for t in own], 1 << 16)
    want = [tokenizer.library.encode(t, add_special_tokens=False).ids for t in own]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))
    assert len(calls) == 1


def test_a_worker_keeps_few_words_for_life():
    """A corpus of ever new words fills no worker: it outlives the stage and stands beside whatever runs next."""
    tokenizer = Tokenizer(open(WORD, encoding="utf-8").read())
    tokenizer.digest = "ever new words"
    words = [f"{a}{b}{c}{d}{e}" for a in PARTS for b in PARTS for c in PARTS for d in PARTS for e in "xy"]
    for start in range(0, len(words), 40_000):
        own = [" ".join(words[i : i + 200]) for i in range(start, min(start + 40_000, len(words)), 200)]
        ids, sizes = tokenizer.encode_batch([t.encode() for t in own], 1 << 16)
        assert sizes.sum() == len(ids)
        assert ids[-sizes[-1] :].tolist() == tokenizer.library.encode(own[-1], add_special_tokens=False).ids
    kept = process_store()[("words", tokenizer.digest)]
    assert len(kept) == 1 << 17 < len(set(words))


def test_a_batch_takes_little_memory():
    """Hashes, signatures and bags of the largest batch that a worker has in its hands."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i:05d}" for i in rng.integers(0, 60_000, 300)).encode() for _ in range(minhash.BATCH_BYTES // 2100)]
    rests = [rng.integers(0, 49_000, 512).astype(np.uint16) for _ in range(packing.BATCH_BYTES // 1024)]
    tokenizer = Tokenizer(open(WORD, encoding="utf-8").read())
    tokenizer.digest = "a batch"
    assert tokenizer.ranks is not None
    for work in (
        lambda: minhash.signatures(minhash.shingle_sets(texts, 5)),
        lambda: packing._bags(rests),
        lambda: tokenizer.encode_batch(texts, 1 << 16),
    ):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 << 20


def test_characters_of_word_lookup():
    """On them the case, classes and composition of the vocabulary with word ends are those of Python and Arrow."""
    easy = [chr(c) for c in range(1, 1 << 16) if not tokens._HARD.search(chr(c))]
    assert len(easy) > 30_000
    assert pc.utf8_lower(pa.array(easy)).to_pylist() == [c.lower() for c in easy]
    assert [c for c in easy if c.isalpha()] == [c for c in easy if re.fullmatch(r"[^\W\d_]", c)]
    assert [c for c in easy if c.isspace()] == list("\t\n\v\f\r ")
    assert all(unicodedata.is_normalized("NFC", c) for c in easy)
    pairs = [unicodedata.decomposition(chr(c)).split() for c in range(1, 1 << 16)]
    assert not {chr(int(x[1], 16)) for x in pairs if len(x) == 2 and not x[0].startswith("<")} & set(easy)


def test_no_token_crosses_a_certain_cut():
    table = inside_pairs([b"ab", b"c", b"bcd"])
    assert table[ord("a"), ord("b")] and table[ord("b"), ord("c")] and not table[ord("b"), ord("a")]
    assert table.sum() == 3


def test_encode_decode_and_count(odd, none):
    library = Library.from_file(BYTE)
    want = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in odd_texts()}
    encoded = bpe.encode(odd, BYTE)
    assert encoded.columns == [c for c in odd.columns if c.lower() not in ("ids", "n_tokens")] + ["ids", "n_tokens"]
    found = bpe.decode(encoded, BYTE).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in odd_texts())
    for r in found:
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["text"]] and r["n_tokens"] == len(want[r["text"]])
        assert r["decoded"] == (r["text"] or "")
    for r in counting.count_tokens(odd, BYTE, batch_bytes=1000, piece_bytes=64).collect():
        assert (r["n_bytes"], r["n_tokens"]) == (len((r["text"] or "").encode()), len(want[r["text"]]))
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert counting.count_tokens(odd.where("doc_id = 5"), model).first()["n_tokens"] > 0
    assert bpe.encode(none, BYTE).count() == counting.count_tokens(none, BYTE).count() == 0


def unit_rows(rng):
    base = rng.normal(size=(60, 8))
    near = base[:20] + 0.1 * rng.normal(size=(20, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *near, base[0], base[0] * 2])]
    bad = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0]]
    return rows + [(1000 + i, v) for i, v in enumerate(bad)] + [(None, None)]


@pytest.mark.parametrize("block", [4, 1024])
def test_near_vectors(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = unit_rows(np.random.default_rng(0))
    path = str(tmp_path / "v")
    spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id bigint, embedding array<double>, n_links int").write.parquet(path)
    found = {r["vec_id"]: r for r in vectors.near_vectors(spark.read.parquet(path)).collect()}
    good = {i: np.array(v) for i, v in rows if i is not None and i < 82}
    links = {
        a: {b for b, y in good.items() if b != a and x @ y >= 0.9 * np.linalg.norm(x) * np.linalg.norm(y)} for a, x in good.items()
    }
    for i in good:
        reach, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        assert (found[i]["n_links"], found[i]["component_id"]) == (len(links[i]), min(reach))
        assert found[i]["first_of_group"] == (min(reach) == i)
    for i in range(1000, 1007):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["first_of_group"]) == (0, i, True)
    assert found[None]["n_links"] == 0
    assert vectors.near_vectors(spark.read.parquet(path).where("vec_id = -1")).count() == 0


def test_forest_recall():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4000, 16))
    both = np.concatenate([base, base + 0.3 * rng.normal(size=base.shape)])
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    pairs = [(i, i + 4000) for i in range(4000) if unit[i] @ unit[i + 4000] >= 0.9]
    forest = vectors.grow(unit[::2], vectors.trees_for(5, 0.9), 5, 1)
    places = [set() for _ in unit]
    for t, tree in enumerate(forest):
        for a, leaf in zip(*vectors.leaves(tree, unit), strict=True):
            places[a].add((t, leaf))
    assert len(pairs) > 500 and np.mean([bool(places[a] & places[b]) for a, b in pairs]) > 0.95


def test_links_of_a_hot_topic(spark, tmp_path):
    """A third of the rows in one dense topic: links are found, and each is counted once."""
    rng = np.random.default_rng(7)
    unit = rng.normal(size=(4500, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    unit[:1500] = np.sqrt(0.85) * unit[-1] + np.sqrt(0.15) * unit[:1500]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    path = str(tmp_path / "hot")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "vec_id bigint, embedding array<double>").write.parquet(path)
    found = np.zeros(len(unit), dtype=np.int64)
    for r in vectors.near_vectors(spark.read.parquet(path)).collect():
        found[r["vec_id"]] = r["n_links"]
    assert want.sum() > 5000 and (found <= want).all() and found.sum() >= 0.97 * want.sum()


def test_too_many_lengths_are_an_error(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    rows = [(i, [1.0] * (1 + i % 3)) for i in range(6)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(path)
    assert all(r["n_links"] == 1 for r in vectors.near_vectors(spark.read.parquet(path)).collect())
    monkeypatch.setattr(vectors, "LENGTHS", 2)
    with pytest.raises(ValueError, match="more than 2 lengths"):
        vectors.near_vectors(spark.read.parquet(path))


def passages() -> list[tuple[int | None, str | None]]:
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    long, short, some = line(60), line(12), [line(20) for _ in range(4)]
    docs = [(i, "\n".join([short, line(30), line(25), line(40)])) for i in range(12)]
    docs += [(20 + i, "\n".join([line(20), long, line(30)])) for i in range(4)]
    docs += [(30, "\n".join([*some, line(9)])), (31, "\n".join([line(9), some[0], "", some[1], " ", *some[2:]]))]
    docs += [(40, "\n".join([line(20)] * 9)), (41, docs[3][1]), (42, docs[3][1]), (42, docs[3][1])]
    return docs + [(50, None), (51, ""), (52, "\n \n"), (None, docs[3][1]), (53, long)]


def plain_dedup(docs):
    """Deletes, in order, every line of a run that begins where an earlier equal run began."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        text = docs[k][1]
        every = [] if text is None else text.split("\n")
        real = [(j, x) for j, x in enumerate(every) if x.split()]
        gone = set()
        for a in range(len(real)):
            total, b = 0, a
            while b < len(real) and total < lines.RUN_WORDS:
                total += len(real[b][1].split())
                b += 1
            run = tuple(x for _, x in real[a:b])
            if total >= lines.RUN_WORDS:
                if run in seen:
                    gone |= {j for j, _ in real[a:b]}
                seen.add(run)
        kept = None if text is None else "\n".join(x for j, x in enumerate(every) if j not in gone)
        out.setdefault(docs[k][0], []).append((kept, len(every), len(gone)))
    return {i: sorted(v, key=repr) for i, v in out.items()}


def test_repeated_lines(spark, tmp_path, odd, none):
    docs = passages()
    path = str(tmp_path / "d")
    rows = [(i, t, "old") for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, N_Lines string").repartition(2).write.parquet(path)
    found: dict = {}
    for r in lines.drop_repeated_lines(spark.read.parquet(path)).collect():
        found.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_deleted"]))
    want = plain_dedup(docs)
    assert {i: sorted(v, key=repr) for i, v in found.items()} == want
    assert sum(n for v in want.values() for _, _, n in v) > 20 and want[0][0][2] == 0
    assert lines.drop_repeated_lines(odd).count() == odd.count()
    assert lines.drop_repeated_lines(none).count() == 0


def plain_passages(docs):
    """Lines left of each document if every passage of enough words that occurs earlier is deleted."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        real = [x for x in text.split("\n") if x.split()]
        gone = set()
        for a in range(len(real)):
            for b in range(a + 1, len(real) + 1):
                if sum(len(x.split()) for x in real[a:b]) >= lines.RUN_WORDS:
                    if tuple(real[a:b]) in seen:
                        gone |= set(range(a, b))
                    seen.add(tuple(real[a:b]))
        out[i] = [x for k, x in enumerate(real) if k not in gone]
    return out


def test_passages_extend_both_ways(spark, tmp_path):
    rng = random.Random(10)
    line = lambda n: " ".join(f"v{rng.randrange(10_000)}" for _ in range(n))
    first, second, third = [line(30), line(30), line(10)], [line(60), line(20)], [line(40), line(15), line(3), line(4)]
    docs = [(10 * k + j, "\n".join([line(9), *x, line(70)])) for k, x in enumerate((first, second, third)) for j in range(3)]
    docs += [(50 + j, "\n".join(third)) for j in range(2)]
    pool = [line(rng.choice([3, 12, 20, 30, 55])) for _ in range(7)]
    docs += [(100 + j, "\n".join(rng.choice([*pool, " "]) for _ in range(9))) for j in range(40)]
    path = str(tmp_path / "d")
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2).write.parquet(path)
    found = lines.drop_repeated_lines(spark.read.parquet(path), extend=True).collect()
    left = {r["doc_id"]: [x for x in r["text"].split("\n") if x.split()] for r in found}
    assert left == plain_passages(docs)
    assert len(left[1]) == len(left[11]) == len(left[21]) == 2 and left[51] == []


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(None, 5), (7, 7)]
    found = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    least = {x: x for pair in links if None not in pair and pair[0] != pair[1] for x in pair}
    for _ in links:
        for a, b in links:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    assert found == least
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def near_docs() -> list[tuple[int | None, str | None]]:
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    docs = []
    for g in range(12):
        base = [word() for _ in range(rng.randint(3, 120))]
        for k in range(rng.randint(1, 9)):
            copy = [word() if rng.random() < 0.02 * k else w for w in base]
            docs.append((100 * g + 50 - k, "  ".join(copy).upper() if k == 1 else "\n".join(copy)))
    return docs + [(5000, None), (5001, ""), (5002, " \t"), (5003, "One"), (5004, "one"), (5005, "one one"), (5006, "É"), (5007, "é")]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, tmp_path, words, odd, none):
    docs = near_docs()
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id bigint, text string, row string").repartition(2).write.parquet(path)
    found = {r["doc_id"]: r for r in minhash.near_duplicates(spark.read.parquet(path), minhash.Rule(words)).collect()}
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + words]) for a in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}
    least = {i: i for i in sets}
    close = [(a, b) for a in sets for b in sets if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in close:
            least[a] = least[b] = min(least[a], least[b])
    for i in sets:
        r = found[i]
        assert (r["n_shingles"], r["component_id"], r["first_of_group"]) == (len(sets[i]), least[i], least[i] == i), i
        assert r["row"] == "z"
    if words == 2:
        assert minhash.near_duplicates(odd).where("first_of_group and doc_id = 5").count() == 1
        assert minhash.near_duplicates(none).count() == 0


def check_packing(rows, want, window):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] > 0
    found = Counter()
    for (doc, total), own in pieces.items():
        copies = Counter(r["start"] for r in own)[0]
        assert sum(r["length"] for r in own) == copies * total
        if copies == 1:
            own.sort(key=lambda r: r["start"])
            found[doc, b"".join(r["ids"] for r in own)] += 1
        else:
            found[next(k for k in want if k[0] == doc and len(k[1]) == 4 * total)] += copies
    assert found == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0


def test_packing(odd, none):
    library = Library.from_file(WORD)
    pack = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    want = Counter((i, pack(t)) for i, t in odd_texts())
    for shard in (1 << 19, 3000):
        rows = packing.pack(odd, WORD, window=256, shard_tokens=shard).collect()
        check_packing(rows, want, 256)
    assert packing.pack(none, WORD).count() == 0


def test_neighbours_come_by_bm25():
    rng = np.random.default_rng(2)
    topics = [rng.integers(100 * t, 100 * t + 40, size=(6, 60)) for t in range(5)]
    items = [packing.Item(i, x.astype(np.uint32), 0) for i, x in enumerate(np.concatenate(topics))]
    index = packing.Index(items)
    plain = np.zeros(len(items))
    bags = [Counter(x.ids.tolist()) for x in items]
    for term in bags[0]:
        spread = sum(term in b for b in bags)
        idf = max(0.0, np.log((len(bags) - spread + 0.5) / (spread + 0.5)))
        plain += [idf * b[term] * 2.2 / (b[term] + 1.2) for b in bags]
    np.testing.assert_allclose(index.scores(0), plain)
    for window in packing.fill(items, 240, last=True):
        if sum(n for _, _, n in window) == 240:
            assert len({item.doc // 6 for item, _, _ in window}) <= 2


def test_used_items_leave_the_index():
    """The scores of the others stay as they are, and bags are those of plain counting."""
    rng = np.random.default_rng(8)
    rests = [rng.integers(0, 300, size=n).astype("<u2" if n % 2 else "<u4") for n in [0, 1, 700, 30, 0, *rng.integers(1, 90, 60)]]
    terms, counts, cuts = packing._bags(rests)
    for k, own in enumerate(rests):
        found = dict(zip(terms[cuts[k] : cuts[k + 1]].tolist(), counts[cuts[k] : cuts[k + 1]].tolist(), strict=True))
        assert found == Counter(own.tolist()) and list(found) == sorted(found)
    assert [len(x) for x in packing._bags([])] == [0, 0, 1] and len(packing._bags([rests[0]])[0]) == 0
    index = packing.Index([packing.Item(i, x.astype(np.uint32), 0) for i, x in enumerate(rests) if len(x)])
    wanted = rng.random(len(index.first) - 1) < 0.4
    before = {i: index.scores(i)[wanted] for i in np.flatnonzero(wanted)}
    index.keep(wanted)
    assert len(index.owner) == wanted[index.owner].sum()
    for i, scores in before.items():
        assert (index.scores(i)[wanted] == scores).all() and not index.scores(i)[~wanted].any()


def test_neighbours_meet_across_partitions(spark, tmp_path):
    """Documents of one topic lie in different partitions and share windows all the same."""
    rng = random.Random(13)
    topics = [[f"{a}{b}" for a in rng.sample(PARTS, 6) for b in rng.sample(PARTS, 4)] for _ in range(8)]
    docs = [(i, " ".join(rng.choice(topics[i // 24]) for _ in range(30))) for i in range(192)]
    path = str(tmp_path / "d")
    spark.createDataFrame(sorted(docs, key=lambda d: (d[0] % 24, d[0])), "doc_id bigint, text string").repartition(8, "doc_id").write.parquet(path)
    whole: dict = {}
    for r in packing.pack(spark.read.parquet(path), WORD, window=256, shard_tokens=2048).collect():
        whole.setdefault(r["sequence_id"], []).append(r["doc_id"] // 24)
    mixed = np.mean([len(set(x)) for x in whole.values() if len(x) > 2])
    assert mixed < 1.6


def test_language_model(odd, none, spark, tmp_path):
    texts = [(i, t) for i, t in odd_texts() if t is None or len(t) < 3000]
    path = str(tmp_path / "d")
    spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3).write.parquet(path)
    bags = [(i, [w.lower() for w in (t or "").encode().split()]) for i, t in texts]
    grams = lambda w: Counter(tuple(w[a : a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1))
    corpus, total = Counter(), sum(len(w) for _, w in bags)
    for _, w in bags:
        corpus += grams(w)
    want = []
    for i, w in bags:
        rest, others, out = Counter(corpus), total - len(w), 0
        rest.subtract(grams(w))
        for k in range(len(w)):
            reach = min(k + 1, 3)
            for n in range(reach, 0, -1):
                own = tuple(w[k - n + 1 : k + 1])
                if rest[own] > 0:
                    base = others if n == 1 else rest[own[:-1]]
                    out += round((np.log(rest[own] / base) + (reach - n) * np.log(0.4)) * 1e6)
                    break
            else:
                out += round((reach * np.log(0.4) - np.log(others + 1)) * 1e6)
        want.append((i, len(w), out / 1e6))
    found = sorted(map(tuple, lm.score(spark.read.parquet(path)).collect()), key=repr)
    assert [x[:2] for x in found] == [x[:2] for x in sorted(want, key=repr)]
    np.testing.assert_allclose([x[2] for x in found], [x[2] for x in sorted(want, key=repr)], atol=1e-4)
    assert lm.score(odd).count() == odd.count() and lm.score(none).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_planes(spark, odd, none, tmp_path, bits):
    library = Library.from_file(BYTE)
    planes.write_ids(odd, str(tmp_path / "ids"), BYTE, 2, block_ids=1000, bits=bits)
    found = planes.read_ids(spark, str(tmp_path / "ids")).collect()
    order = sorted(odd_texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    found.sort(key=lambda r: r["start"])
    for (i, t), r in zip(order, found, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["id"], r["start"], r["n_tokens"]) == (i, start, len(ids)) and r["ids"] == ids.tobytes()
        start += len(ids)
    planes.write_ids(none, str(tmp_path / "no"), BYTE, 2)
    assert planes.read_ids(spark, str(tmp_path / "no")).count() == 0


def test_plane_blocks():
    ids = np.random.default_rng(0).integers(0, 1 << 32, 1001, dtype=np.uint32)
    for bits in (False, True):
        assert (planes.from_planes(planes.to_planes(ids, bits), len(ids)) == ids).all()


def test_sharding(odd, none):
    found = shards.shuffle_into_shards(odd, 8, bucket_rows=2)
    assert found.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]
    rows = found.collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(repr, odd_texts()))
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sizes[k]))
    assert shards.shuffle_into_shards(none, 8).count() == 0


def test_sharding_is_uniform(spark, tmp_path):
    path = str(tmp_path / "n")
    spark.range(400).repartition(5).write.parquet(path)
    hits = np.zeros((400, 4))
    for seed in range(12):
        for r in shards.shuffle_into_shards(spark.read.parquet(path), 4, seed=seed, bucket_rows=30).collect():
            hits[r["id"], r["shard"]] += 1
    assert (hits.sum(axis=0) == 1200).all()
    assert ((hits - 3) ** 2 / 3).sum() < 1200 + 5 * np.sqrt(2 * 1200)
    matrix = shards.communication_matrix([5, 0, 7, 3], np.array([4, 4, 4, 3]), 1)
    assert matrix.sum(axis=0).tolist() == [4, 4, 4, 3] and matrix.sum(axis=1).tolist() == [5, 0, 7, 3]


def plain_counts(text: str | None) -> tuple:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    wins = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    real = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(real) - len(set(real)), len(hit)


def test_quality(spark, odd, none, tmp_path):
    rng = random.Random(6)
    clean = [(300 + i, prose(rng, 120)) for i in range(30)]
    junk = [(400 + i, " ".join(f"{rng.choice(WORDS).upper()}!!#" for _ in range(120))) for i in range(15)]
    looped = [(500, "one two three four " * 40), (501, "a b c " + prose(rng, 60) + "a b c d\nx\nx")]
    path = str(tmp_path / "d")
    rows = [(*r, "old") for r in clean + junk + looped + odd_texts()]
    spark.createDataFrame(rows, "doc_id bigint, text string, KEPT string").write.parquet(path)
    labels = [(i, 1, 0) for i, _ in clean[:20]] + [(i, 0, 0) for i, _ in junk[:10]] + [(None, 1, 0), (302, None, None), (303, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = quality.judge(spark.read.parquet(path), marks).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in found:
        want = plain_counts(r["text"])
        assert tuple(r[c] for c in names) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 50 or 2 * want[4] > want[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in found if r["kept"]}
    judged = quality.judge(spark.read.parquet(path), marks).where("kept")
    assert {r["doc_id"] for r in judged.select("doc_id").collect()} == kept
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    # A filter further down would compute the words again and again.
    assert re.search(r"Filter [^\n]*kept#\d+", plan).start() < plan.index("split(")
    assert {i for i, _ in clean} <= kept and not kept & {i for i, _ in junk}
    few = spark.createDataFrame([], marks.schema)
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(odd, few).collect())
    assert quality.judge(none, marks).count() == 0


def test_score_is_the_mean_log_ratio(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, "a b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    ratios = model.ratios.first()["ratio"]
    rated = quality.scored(quality.base_counts(docs), model.ratios)
    lists = {r["doc_id"]: r["f"] for r in rated.select("doc_id", quality.features(rated["word_keys"]).alias("f")).collect()}
    assert len(ratios) == quality.BUCKETS and [len(lists[i]) for i in (1, 2, 3)] == [5, 1, 3]
    raw, target = Counter(b for f in lists.values() for b in f), Counter(lists[1])
    for b in raw:
        want = np.log((target[b] + 1) / (5 + quality.BUCKETS)) - np.log((raw[b] + 1) / (9 + quality.BUCKETS))
        assert ratios[b] == pytest.approx(want)
    for r in rated.collect():
        assert r["score"] == pytest.approx(np.mean([ratios[b] for b in lists[r["doc_id"]]]))


def test_border_keeps_the_trusted():
    scores = np.concatenate([np.linspace(0, 1, 1000), np.linspace(-2, 0.5, 400)])
    trusted = np.array([1] * 1000 + [0] * 400)
    at = quality.border(trusted, scores)
    assert (scores[:1000] >= at).mean() >= quality.KEEP and at > -0.01
    assert quality.border(trusted[:1000], scores[:1000]) == float("-inf")


