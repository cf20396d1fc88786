"""Vector codes, main text of pages, and importance resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewell.llm import codes, html, resampling
from tidewell.llm.labelled import links, par, text

# --- vector codes ----------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds, scale):
    """Plain search with Python integers; rows of (key, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    length = max((len(v) for _, v, _ in kept), default=0)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(scale * x) for x in v] + [0] * (length - len(v)) for _, v, _ in kept]
    cut = [(p * length // parts, (p + 1) * length // parts) for p in range(parts)]
    books = [[row[a:b] for row in ints[:entries]] for a, b in cut]

    def nearest(row, p):
        piece = row[slice(*cut[p])]
        return min((sum((x - y) ** 2 for x, y in zip(piece, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(row, p)[1] for p in range(parts)] for row in ints]
        for p in range(parts):
            members = defaultdict(list)
            for row, code in zip(ints, found, strict=True):
                members[code[p]].append(row[slice(*cut[p])])
            for e, pieces in members.items():
                books[p][e] = [sum(c) // len(pieces) for c in zip(*pieces, strict=True)]
    out = []
    for (key, _, label), row in zip(kept, ints, strict=True):
        best = [nearest(row, p) for p in range(parts)]
        out.append((key, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), label))
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    return out, digest


def vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, code string, ERROR int")
    return frame.repartition(3)


def test_codes_equal_a_plain_search(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 10))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.15, 10)).tolist(), i % 4 or None) for i in range(300)]
    rows += [(400, [0.5] * 10, 1), (400, [0.5] * 10, 1), (None, [0.25] * 10, None), (401, [0.1] * 7, 2), (402, [], 2)]
    rows += [(500, None, 1), (501, [1.0, None] * 5, 1), (502, [float("nan")] * 10, 1), (503, [float("inf")] * 10, 1)]
    rows += [(600 + i, [float(j % 2) for j in range(10)], 9) for i in range(30)]
    for rounds in (0, 1, 2, 5):
        found, books = codes.compress(vectors(spark, [(*r, "x", 1) for r in rows]), parts=4, entries=12, rounds=rounds)
        want, digest = plain_codes(rows, 4, 12, rounds, 256)
        assert books.digest() == digest
        summed = codes.with_group_sums(found, "label").collect()
        assert Counter((r.vec_id, r.code, r.error, r.label) for r in summed) == Counter(want)
        sums = Counter()
        for _, _, error, label in want:
            sums[label] += error
        assert all(r.label_error == sums[r.label] for r in summed)


def test_codes_of_huge_components(spark):
    rows = [(i, [10.0 ** (i % 40), -(3.5**i), 0.1 * i], 1) for i in range(40)]
    found, books = codes.compress(vectors(spark, [(*r, "x", 1) for r in rows]), parts=2, entries=5, rounds=2)
    want, digest = plain_codes(rows, 2, 5, 2, 256)
    assert books.wide and books.digest() == digest
    assert sorted((r.vec_id, r.code, r.error) for r in found.collect()) == [
        (k, c, e if e < 2**63 else None) for k, c, e, _ in sorted(want)
    ]


def test_codes_of_no_rows(spark):
    found, books = codes.compress(vectors(spark, [(1, None, 1, "x", 1)]))
    assert found.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()
    assert codes.with_group_sums(found, "label").count() == 0
    with pytest.raises(ValueError):
        codes.compress(vectors(spark, [(1, [1.0], 1, "x", 1)]), entries=300)


def test_bounds_spare_scans_and_change_nothing():
    """Bounds from several states: exact results, far fewer distances once entries rest."""
    rng = np.random.default_rng(2)
    rows = np.floor(256 * (rng.normal(0, 3, (40, 8))[rng.integers(0, 40, 4000)] + rng.normal(0, 0.2, (4000, 8))))
    books = codes.Codebooks([[rows[:64, :4], rows[:64, 4:]]], 256)
    state, counts = None, []
    for _ in range(6):
        state, errors, n = codes.assign(rows, books, state)
        plain = [((rows[:, None, s] - b[None]) ** 2).sum(-1) for s, b in zip((slice(4), slice(4, 8)), books.history[-1], strict=True)]
        assert np.array_equal(state.assigned, np.column_stack([d.argmin(axis=1) for d in plain]))
        assert np.array_equal(errors, sum(d.min(axis=1) for d in plain))
        counts.append(int(n.sum()))
        moved = [b.copy() for b in books.history[-1]]
        for p, s in enumerate((slice(4), slice(4, 8))):
            for e in range(64):
                if (state.assigned[:, p] == e).any():
                    moved[p][e] = np.floor(rows[state.assigned[:, p] == e][:, s].mean(axis=0))
        books = codes.Codebooks([*books.history, moved], 256)
    assert counts[-1] < counts[0] / 2
    assert len(np.unique(state.stamps)) > 1


def test_net_displacement_is_at_most_the_sum_of_moves():
    rng = np.random.default_rng(1)
    history = [[np.floor(rng.normal(0, 100, (5, 3)))] for _ in range(4)]
    net = codes.displacements(codes.Codebooks(history, 1), 0)
    drift = sum(np.sqrt(((b[0] - a[0]) ** 2).sum(axis=1)) for a, b in zip(history, history[1:], strict=False))
    assert (net[0] <= drift * (1 + 1e-6)).all() and (net[0] < drift).any() and not net[-1].any()


# --- main text of pages ----------------------------------------------------------------------------


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices("aeionrstlmd", k=rng.randint(1, 9))) for _ in range(words))


def held_out(rng: random.Random) -> tuple[str, list[str]]:
    """A page of one of several templates, and the blocks of its article."""
    want = [prose(rng, rng.randint(3, 12))] + [prose(rng, rng.randint(1, 90)) for _ in range(rng.randint(1, 8))]
    body = f"<h1>{want[0]}</h1>" + "".join(f"<p>{p}" + rng.choice(["</p>", "", "</p>\n "]) for p in want[1:])
    junk = [
        f'<nav><ul>{links(rng.randint(2, 8))}</ul></nav>',
        f'<div class="{rng.choice(["ad", "adBanner", "top-ads", "sponsored"])}"><p>{prose(rng, 20)}</p></div>',
        f'<div id="cookie-consent">{prose(rng, 30)} <button>OK</button></div>',
        f'<header class="site"><a href="/">{prose(rng, 2)}</a></header>',
        f'<form action="/s"><input name="q"><label>{prose(rng, 4)}</label><select><option>{prose(rng, 2)}</select></form>',
        f"<script>var a = '<p>{prose(rng, 9)}</p>';</script><style>p {{ color: red }}</style><!-- <p>{prose(rng, 9)}</p> -->",
    ]
    after = [
        f'<section class="comments"><h3>{prose(rng, 1)}</h3><p>{prose(rng, 60)}</p></section>',
        f'<aside><h2>{prose(rng, 2)}</h2><p>{prose(rng, 40)}</p></aside>',
        f"<footer>&copy; {prose(rng, 6)}</footer>",
        f'<div role="complementary">{prose(rng, 15)}</div>',
    ]
    rng.shuffle(junk), rng.shuffle(after)
    box = rng.choice(["article", "main", 'div class="entry-content"', 'div id="articleBody"', 'section class="post no-sidebar"'])
    page = f"<!DOCTYPE html><html><head><title>{want[0]}</title></head><body class='has-menu'>{''.join(junk[:4])}<{box}>{body}</{box.split()[0]}>{''.join(after[:3])}"
    return page + rng.choice(["</body></html>", "", "</body>"]), want


def test_held_out_pages_of_named_places():
    rng, tree = random.Random(11), html.train(html.PAGES)
    for _ in range(300):
        page, want = held_out(rng)
        assert html.main_text(page, tree)[0].split("\n") == want


def test_pages_without_names_by_words_links_and_neighbours():
    rng, tree = random.Random(12), html.train(html.PAGES)
    right = total = 0
    for _ in range(200):
        want = [prose(rng, rng.randint(5, 10))] + [prose(rng, rng.randint(15, 90)) for _ in range(rng.randint(2, 6))]
        menu, more = links(rng.randint(4, 9), rng.randint(1, 4)), links(rng.randint(3, 6), rng.randint(2, 9))
        page = f"<body><ul>{menu}</ul><h1>{want[0]}</h1>{''.join(f'<p>{p}</p>' for p in want[1:])}<ul>{more}</ul></body>"
        got, blocks, _ = html.main_text(page, tree)
        wrong = set(got.split("\n")) ^ set(want)
        right, total = right + blocks - len(wrong), total + blocks
    assert right / total >= 0.98


def test_the_tree_asks_for_places_words_and_links():
    def asked(tree):
        return {html.FEATURES[tree[0]]} | asked(tree[2]) | asked(tree[3]) if len(tree) > 1 else set()

    tree = html.train(html.PAGES)
    assert {"inside", "outside", "density"} <= asked(tree) and asked(tree) & {"words", "words_before", "words_after"}


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("<", ""),
        ("<article><p>a &amp; b&nbsp;c &eacute;&am", "a & b c é&am"),
        ("<article><p>one<br>two\n\t three <b>f</b>our</p>five</article>", "one two three four\nfive"),
        ("<article><p>1 < 2 and <3></p></article>", "1 < 2 and <3>"),
        ("<article><p>whole</p><p>cut <a href='x", "whole\ncut"),
        ("<article><p>seen</p><script>if (a < b) '</p>';</script><p>too</p></article>", "seen\ntoo"),
        ("<article><p title='a > b'>quoted</p><p hidden>gone</p><p style='display: none'>gone</p></article>", "quoted"),
        ("<article><h1>t</h1><article class='comment'><p>" + text(40) + "</p></article></article>", "t"),
        ("<ARTICLE><P>upper</P></ARTICLE>" + par(40), "upper"),
        ("<nav>" + links(3) + "</nav>", ""),
        ("<article><!-- open", ""),
    ],
)
def test_odd_markup(page, want):
    assert html.main_text(page, html.train(html.PAGES))[0] == want


def test_long_pages_take_time_in_proportion():
    page = "<article>" + "<p>word &amp; <b>word</b>" * 60_000 + "<a href='" * 2_000
    assert html.main_text(page, html.train(html.PAGES))[2] == 60_000


def test_extract_keeps_rows_and_columns(spark):
    rows = [(1, None, "x", 5), (2, "", "x", 5), (3, "<article><p>été</p></article>", None, None), (3, "<article><p>été</p></article>", None, None)]
    pages = spark.createDataFrame(rows, "page_id int, html string, TEXT string, n_kept int")
    found = html.extract(pages)
    assert found.columns == ["page_id", "html", "text", "n_chars", "n_blocks", "n_kept"]
    assert sorted((r.page_id, r.text, r.n_chars, r.n_kept) for r in found.collect()) == [(1, "", 0, 0), (2, "", 0, 0), (3, "été", 3, 1), (3, "été", 3, 1)]
    assert html.extract(pages.where("page_id = 9")).count() == 0


# --- importance resampling -------------------------------------------------------------------------


def plain_grams(value, longest):
    lowered = (value or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plain_resample(docs, target, longest, buckets, percent, least, seed):
    def hashed(value):
        return Counter(zlib.crc32(g.encode()) % buckets for g in plain_grams(value, longest)[0])

    raw, aim = Counter(), Counter()
    for _, value in docs:
        raw += hashed(value)
    for value in target:
        aim += hashed(value)
    s, t = raw.total(), aim.total()
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for key, value in docs:
        own = hashed(value)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in own.items())
        rows.append((key, own.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r, (_, v) in zip(rows, docs, strict=True) if plain_grams(v, longest)[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return rows, [r[0] for r in drawn], [r[3] for r in drawn]


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 50, 40), (2, 1, 100)])
def test_resampling_equals_a_plain_version(spark, tmp_path, longest, buckets, percent):
    rng = random.Random(longest)
    words = "the River été 中文 a-b 12 x_y O'Neil \U0001f600 Straße İ _ - 7".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(250)]
    docs += [(7, docs[7][1])] * 40 + [(None, docs[3][1]), (None, None), (300, None), (301, ""), (302, "a " * 30_000), (303, "x" * 90_000)]
    target = ["the river the river", None, "", "中文 12"]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id bigint, text string, SCORE string, buckets int").repartition(5).write.parquet(path)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(spark.read.parquet(path), aim, longest=longest, buckets=buckets, percent=percent)
    got = found.collect()
    rows, drawn, scores = plain_resample(docs, target, longest, buckets, percent, 20, 2024)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(rows)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r.doc_id for r in ranked] == drawn and [r.score for r in ranked] == scores
    assert "text" in found.columns and "buckets" not in found.columns


def test_resampling_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    aim = spark.createDataFrame([("a",)], "text string")
    assert resampling.resample(docs, aim).count() == 0
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id bigint, text string")
    assert resampling.resample(some, aim.where("text = ''"), percent=100).first()["rank"] == 1
