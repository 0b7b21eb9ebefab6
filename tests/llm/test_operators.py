"""The operators on small tables, against brute force and on odd rows."""

import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchweave.llm import exact_dedup as ed
from sketchweave.llm import jaccard_join as jj
from sketchweave.llm.common import Scratch
from sketchweave.llm.components import components
from sketchweave.llm.exact_dedup import exact_dedup
from sketchweave.llm.html_extract import extract, extract_pages
from sketchweave.llm.jaccard_join import jaccard_components
from sketchweave.llm.langid import identify
from sketchweave.llm.license_scan import TEMPLATES, scan
from sketchweave.llm.mixing import mix
from sketchweave.llm.packing import conversation_examples, pack_documents, pack_examples
from sketchweave.llm.quality import classify
from sketchweave.llm.queries import op1_scan_licenses, tokenizer_file
from sketchweave.llm.suffix_dedup import dedup_substrings
from sketchweave.llm import vector_dedup as vd
from sketchweave.llm.vector_dedup import near_vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, tokens string, size string"


def documents(spark):
    """Copies, near copies, shared passages, nulls, ties, empty and long texts, and columns with clashing names."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = sentence(40), sentence(60)
    texts = [sentence(rng.randint(1, 80)) for _ in range(25)]
    texts += [base] * 3 + [base.upper()] + [" ".join([*base.split()[:k], "zz", *base.split()[k + 1 :]]) for k in (5, 20, 58)]
    texts += [f"{sentence(30)}\n{passage}\n{sentence(9)}" for _ in range(4)]
    texts += [None, "", " \t\n", "ÀÉÎ àéî", "one two", "One two", sentence(3000), "Released under the MIT License."]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None, "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows.append((None, "a row without id " * 6, None, "c", None, None, None, None, None))
    return spark.createDataFrame(rows, DOCS)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("digest", [ed.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_dedup(spark, docs, keep, digest):
    rows = pairs(docs)
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    best = lambda g: (max if keep == "max" else min)([i for i in g if i is not None], default=None)
    want = Counter((i, best(groups[fold(t)]), len(groups[fold(t)]), i == best(groups[fold(t)])) for i, t in rows)
    got = exact_dedup(docs, keep=keep, digest=digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    assert exact_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("keep", ["max", "min"])
def test_digest_index_merges_runs_by_level(spark, keep):
    scratch, rng = Scratch(spark, "test"), random.Random(4)
    index, rows = ed.DigestIndex(scratch, keep, fanout=3), []
    for _ in range(8):
        batch = [(rng.randrange(1000), f"d{rng.randrange(40)}") for _ in range(30)]
        rows += batch
        index.flush(spark.createDataFrame(batch, "id long, digest string"))
        index.compact()
    assert [len(level) for level in index.levels] == [2, 2]
    best = max if keep == "max" else min
    want = {d: (best(i for i, x in rows if x == d), sum(x == d for _, x in rows)) for _, d in rows}
    assert {r.digest: (r.winner, r.n) for r in index.winners().collect()} == want
    index.compact(whole=True)
    assert sum(map(len, index.levels)) == 1 and {r.digest: (r.winner, r.n) for r in index.winners().collect()} == want


@pytest.mark.parametrize("n", [0, 1, 500])
def test_digest_filter_misses_nothing(spark, n):
    digests = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    every = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    got = {r.id for r in ed.DigestFilter(digests, n).probe(every).collect()}
    assert set(range(n)) <= got and len(got) <= n + 20_000 * 0.12


def test_mixing(spark, docs):
    got = mix(docs).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in pairs(docs)}
    assert {r.doc_id: r.size for r in got} == sizes
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert [(r.doc_id, r.taken) for r in sorted(mix(docs).collect(), key=str)] == [(r.doc_id, r.taken) for r in sorted(got, key=str)]
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    total = sum(sizes.values())
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(total)
    for rs in by.values():
        assert rs[0].source_size == sum(r.size for r in rs) and rs[0].target <= 3 * rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 3 * max(r.size for r in rs)
    assert mix(empty(spark)).count() == 0
    assert [r.target for r in mix(docs.where("text = ''")).collect()] == [0.0]


def test_mixing_stays_near_large_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 300), f"s{i % 3 if i % 2 else 0}") for i in range(3000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r.t - r.w) <= 0.01 * r.w for r in got)


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_file())
    want = {i: coder.encode(t or "", add_special_tokens=False).ids + [1] for i, t in pairs(docs)}
    got = pack_documents(docs.repartition(2), tokenizer_file(), tokens=256, segments=9).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, rs in by_doc.items():
        ends = [(r.start, r.start + r.length) for r in sorted(rs, key=lambda r: r.start)]
        assert ends[0][0] == 0 and ends[-1][1] == len(want[i]) and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and len(rs) <= 9
    assert len(by_doc) == docs.count() and pack_documents(empty(spark), tokenizer_file()).count() == 0


def test_packing_examples(spark):
    rows = [(i, i * 37 % 900, i * 37 % 900 // 2) for i in range(200)] + [(900, 5000, 10), (901, None, None)]
    got = pack_examples(spark.createDataFrame(rows, "conv long, n long, m long").coalesce(1), "conv", "n", "m", segments=8, loss=700).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    assert sorted(r.conv for r in got) == sorted(i for i, _, _ in rows)
    for rs in by.values():
        assert len(rs) == 1 or sum(r.tokens for r in rs) <= 2048 and sum(r.loss_tokens for r in rs) <= 700 and len(rs) <= 8


def test_packing_conversations(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_file())
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    odd = [(9001, 0, "assistant", None), (9001, 1, None, "what?"), (None, 0, "assistant", "lost " * 3000), (9002, 0, "user", "")]
    turns = turns.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    want = defaultdict(lambda: [0, 0])
    for r in turns.collect():
        n = len(coder.encode(r.text or "", add_special_tokens=False).ids) + 1
        want[r.conv_id][0] += n
        want[r.conv_id][1] += n * (r.role == "assistant")
    examples = conversation_examples(turns, tokenizer_file())
    assert {r.conv_id: [r.tokens, r.loss_tokens] for r in examples.collect()} == want
    by = defaultdict(list)
    for r in pack_examples(examples, "conv_id", "tokens", "loss_tokens", segments=16, loss=1024).collect():
        assert want[r.conv_id] == [r.tokens, r.loss_tokens]
        by[r.sequence_id].append(r)
    assert sorted(str(r.conv_id) for rs in by.values() for r in rs) == sorted(map(str, want))
    for rs in by.values():
        assert [r.offset for r in sorted(rs, key=lambda r: r.offset)] == np.cumsum([0, *[r.tokens for r in sorted(rs, key=lambda r: r.offset)]])[:-1].tolist()
        assert len(rs) == 1 or sum(r.tokens for r in rs) <= 2048 and sum(r.loss_tokens for r in rs) <= 1024 and len(rs) <= 16


def test_quality(spark, docs):
    rows = [(i, "plain words of a good text " * 5, 1) for i in range(1000, 1040)] + [(i, "BUY!! NOW!! $$$ " * 9, 0) for i in range(1040, 1080)]
    extra = docs.unionByName(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = classify(extra, labels)
    assert set(docs.columns) <= set(got.columns)
    scores = {r.doc_id: r for r in got.collect()}
    assert len(scores) == extra.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scores.values())
    assert all(scores[i].predicted == q for i, _, q in rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scores.items() if i is not None)
    assert {r.predicted for r in classify(docs, labels.limit(0)).collect()} == {1}
    assert classify(empty(spark), labels).count() == 0


def test_language(spark, docs):
    text = {"en": "the cat and the other hat of theirs ", "de": "der hund und die katze mit dem hut "}
    rows = [(i, text[lang] * 3, lang) for lang in text for i in range(2000 + 100 * (lang == "de"), 2040 + 100 * (lang == "de"))]
    rows += [(1, None, "en"), (2, "12 !!", "de"), (None, "die katze", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(df, tokenizer_file("piece_bpe_32k.model")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i and i > 1000)
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[None].lang_pred == "de"
    assert {r.lang_pred for r in identify(df.withColumn("lang", F.lit(None).cast("string")), tokenizer_file("piece_bpe_32k.model")).collect()} == {"und"}
    assert identify(empty(spark), tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_licences(spark, docs):
    got = {r.doc_id: r for r in scan(docs).collect()}
    assert len(got) == docs.count()
    hits = [r for r in got.values() if r.n_hits]
    assert [r.family for r in hits] == ["mit"] and hits[0].hits[0].start == 0
    assert scan(empty(spark)).count() == 0


def test_licence_query_returns_every_notice(spark, tmp_path):
    mit, gpl = (TEMPLATES[f][0] for f in ("mit", "gpl"))
    text = f"Some code of ours.\n\n{mit}\n\nAnd of others.\n\n{gpl}"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = op1_scan_licenses(spark, str(tmp_path)).first()
    named = [h for h in row.hits if h.family != "unknown"]
    assert [h.family for h in named] == ["mit", "gpl"] and (row.n_hits, row.n_unknown) == (2, len(row.hits) - 2)
    assert [text[h.start : h.end] for h in named] == [mit.rstrip("."), gpl.rstrip(".")]


MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def test_licences_in_wrapped_paragraphs(spark):
    wrap = lambda text, mark="", width=72: "\n".join(mark + x for x in textwrap.wrap(text, width))
    notices = [(wrap(MIT, width=80), "mit"), (wrap(MIT, " * "), "mit"), (wrap(TEMPLATES["bsd"][0], "# ", 60), "bsd"), (wrap(TEMPLATES["lgpl"][0], "// "), "lgpl"), (wrap(TEMPLATES["apache"][1], "-- "), "apache")]
    notices += [(wrap(ISC), "unknown"), ("Eclipse Public License - v 2.0", "unknown"), ("ISC License", "unknown"), (wrap("This program and the accompanying materials are made available under the terms of the Eclipse Public License v 2.0"), "unknown")]
    prose = [("The driver lost the license.\nAll of it was read, and nothing was left of the rights of the others to it\nwhen they came", None), ("", None), (None, None), ("MIT", None)]
    rows = [(i, f"Some text before, at length.\n\n{t}\n\nSome text after." if f else t, f) for i, (t, f) in enumerate(notices + prose)]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string, family string")).collect()}
    for i, text, family in rows:
        families = {h.family for h in got[i].hits or []}
        assert families - {"unknown"} == ({family} if family and family != "unknown" else set()), text
        assert ("unknown" in families) == (family == "unknown") or family and family != "unknown", text
        assert got[i].family == (family if family != "unknown" else None), text
    # A notice is one hit, from its first word to its last.
    hit = got[0].hits[0]
    assert len(got[0].hits) == 1 and rows[0][1][hit.start : hit.end] == notices[0][0].rstrip(":")


def test_licences_against_a_search_for_the_notices(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lines = {"Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "all-rights-reserved", "Licensed under the Apache License, Version 2.0.": "apache", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    want = {r.doc_id: sorted((r.text.encode().find(x.encode()), f) for x, f in lines.items() if x in (r.text or "")) for r in documents.collect()}
    got = {r.doc_id: [(h.start, h.family) for h in r.hits] for r in scan(documents).collect()}
    assert got == want and sum(map(len, want.values())) > 10


def test_substrings(spark, docs):
    want, seen = {}, {}
    for i, t in sorted(pairs(docs), key=lambda r: float("inf") if r[0] is None else r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for q in range(len(raw) - 49):
            w = raw[q : q + 50]
            if seen.setdefault(w, i) != i:
                gone[q : q + 50] = b"\1" * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    for block in (1 << 20, 3000):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_substrings(docs, block=block).collect()}
        assert got == want
    assert any(w[1] for w in want.values())
    assert dedup_substrings(empty(spark)).count() == 0


def jaccard_brute(rows, width, percent):
    """n and component of every row of (id, text): rows link, and the smallest id that isn't null names a component."""

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and root(a) != root(b) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        low[root(k)].append(i)
    name = {k: min((i for i in ids if i is not None), default=None) for k, ids in low.items()}
    return Counter((i, len(s), name[root(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def jaccard_rows(df, **options):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, **options).collect())


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard(spark, docs, width, percent):
    assert jaccard_rows(docs, width=width, percent=percent) == jaccard_brute(pairs(docs), width, percent)
    assert jaccard_components(empty(spark)).count() == 0


def test_jaccard_links_rows_without_id_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text), (None, text + " x"), (5, text + " x y"), (None, "a lone row of six words"), (5, text), (9, text + " z"), (9, "other words of another text here"), (None, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard_rows(df) == jaccard_brute(rows, 4, 85)


@pytest.mark.parametrize("members", [2, 5, 1000])
def test_jaccard_families_over_many_blocks(spark, monkeypatch, members):
    """Stars, chains, and relatives just under the similarity, all sharing a line."""
    rng = random.Random(11)
    monkeypatch.setattr(jj, "MEMBERS", members)
    monkeypatch.setattr(jj, "VISITORS", 3)
    monkeypatch.setattr(jj, "BLOCK", 6000)
    words = [f"{rng.choice('abcde')}{i}" for i in range(900)]
    line, texts = [rng.choice(words) for _ in range(9)], []
    for size, changes in ((30, 1), (30, 2), (25, 3), (12, 0)):
        base = [rng.choice(words) for _ in range(90)]
        for k in range(size):
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(line + w))
    chain = [rng.choice(words) for _ in range(80)]
    texts += [" ".join(line + chain[3 * k :] + [f"c{j}" for j in range(3 * k)]) for k in range(12)]
    texts += [" ".join(line + [rng.choice(words) for _ in range(40)]) for _ in range(40)]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((4, 85), (5, 80)):
        assert jaccard_rows(df, width=width, percent=percent) == jaccard_brute(rows, width, percent)


def test_vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 16))
    x = [(centres[i % 40] + 0.03 * rng.standard_normal(16) * (i % 3)).astype(np.float32) for i in range(300)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400, x[0].tolist()), (401, (x[0] * 2).tolist()), (402, None), (403, [0.0] * 16), (404, [float("nan")] * 16), (405, [1.0] * 3), (406, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit("x"))
    good = {i: np.array(v, float) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = {i: {j for j in unit if j != i and unit[i] @ unit[j] >= 0.95} for i in unit}
    parent = {i: i for i, _ in rows}
    root = lambda a: a if parent[a] == a else root(parent[a])
    for i in links:
        for j in links[i]:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(links.get(i, ())), root(i), root(i) == i) for i, _ in rows}
    assert near_vectors(df.limit(0)).count() == 0 and near_vectors(df.where("vec_id = 403")).first().n_links == 0


def test_vectors_without_id_link(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (None, [1.0, 0.01, 0.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 1.0]), (7, [0.0, 1.0, 0.0]), (6, [1.0, 0.0, 0.0])]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == Counter([(5, 2, 5, True), (None, 2, 5, False), (None, 1, None, True), (None, 1, None, True), (7, 0, 7, True), (6, 2, 5, False)])


def test_vectors_over_many_shards(spark, monkeypatch):
    """Groups large and small, pairs, chains and single vectors in some 30 shards, against brute force."""
    monkeypatch.setattr(vd, "SHARD", 100)
    rng = np.random.default_rng(12)
    parts = [rng.standard_normal((1200, 24))]
    for size, count, noise in ((400, 1, 0.05), (40, 8, 0.08), (2, 300, 0.08), (3, 100, 0.1)):
        parts += [c + noise * rng.standard_normal((size, 24)) for c in rng.standard_normal((count, 24))]
    x = np.concatenate(parts)[rng.permutation(sum(len(p) for p in parts))]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    linked = want > 0
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum() and (found[linked] / want[linked]).mean() >= 0.95
    assert all(got[i].component_id <= i for i in range(len(x)))


def test_vector_audit_sees_rare_misses(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 32))
    x[1:120:2] = x[0:120:2]
    x[1:120:2, 0] += 0.01
    classes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "rep long, w long, vec array<double>")
    # Of 60 pairs every second one is missed from both ends.
    counts = spark.createDataFrame([(i, 1) for i in range(120) if i % 4 < 2], "rep long, near long")
    assert vd.audited(classes, counts, 32, 0.95, vd.AUDIT) == 0.5


def test_vectors_are_compared_exactly_when_recall_stays_low(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((300, 16)), 4, axis=0) + 0.03 * rng.standard_normal((1200, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    once, exact = vd._search_once, []
    monkeypatch.setattr(vd, "audited", lambda *_: 0.0)
    monkeypatch.setattr(vd, "_search_once", lambda *a: exact.append(a[8]) or once(*a))
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert exact == [False, True]
    assert [got[i] for i in range(1200)] == ((u @ u.T >= 0.95).sum(axis=1) - 1).tolist()


def test_vectors_of_every_width_are_compared(spark):
    rows = [(i, [float(i), 1.0, 2.0, 3.0]) for i in range(5)] + [(5, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [2.0, 4.1]), (8, [1.0, -1.0]), (9, [1.0]), (10, [1.0]), (11, []), (12, [])]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v}
    links = {i: [j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i, _ in rows if i in unit}
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(links.get(i, ())) for i, _ in rows}
    assert [got[i].component_id for i in range(5, 13)] == [5, 5, 5, 8, 9, 9, 11, 12]


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>A, b.</p></article>"), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    assert sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in extract_pages(df).collect()) == [("1", "u", "A, b.", 5), ("2", None, "", 0), ("None", "v", "", 0)]
    assert extract_pages(df.limit(0)).count() == 0


def test_pages_keep_all_content():
    long, short = "Some words, and more of them. " * 24, "Other words, and a few more. " * 10
    lines = lambda *t: "\n".join(x.strip() for x in t)
    assert extract(f"<body><div><p>{long}</p></div><div><p>{short}</p></div></body>") == lines(long, short)
    assert extract(f"<p>{long}</p><p>{short}</p>") == lines(long, short)
    assert extract(f"<body><table><tr><td>{long}</td></tr><tr><td>{short}</td></tr></table><p>{short}</p></body>") == lines(long, short, short)
    assert extract(f"<body><ul><li>{long}</li><li>{short}</li></ul><div><p>{short}</p></div></body>") == lines(long, short, short)
    assert extract(f"<article><p>{long}</p><ul><li><a>One</a></li><li><a>Two</a></li></ul></article>") == lines(long, "One", "Two")
    assert extract(f"<body><article><p>{long}</p></article><article><p>{short}</p></article></body>") == lines(long, short)
    assert extract(f"<body><nav><a>Home</a></nav><div><a>Home</a></div><p>{long}</p><p>{short}</p><footer>End</footer></body>") == lines(long, short)


def test_pages_with_wrappers_headers_and_menus():
    long, short = ("Some words, and more of them. " * 24).strip(), ("Other words, and a few more. " * 10).strip()

    def same(page, *blocks):
        assert extract(page) == "\n".join(blocks)

    same(f'<body><div class="content has-sidebar"><p>{long}</p><p>{short}</p></div></body>', long, short)
    same(f'<body><div class="post no-ads"><p>{long}</p></div></body>', long)
    same(f'<body><form id="aspnetForm"><div><p>{long}</p></div><input value=x></form></body>', long)
    same(f'<body><div class="post"><div class="entry-header"><h1>Title</h1><span>by me</span></div><p>{long}</p><p>{short}</p></div></body>', "Title", long, short)
    same(f'<body><div id=page><header><h1>Site</h1></header><div id="content"><div class="entry-header"><h1>Title</h1></div><p>{long}</p></div></div></body>', "Title", long)
    same(f"<body><div><p>Home</p><p>About</p></div><div><h1>Title</h1><p>{long}</p><p>Short</p></div><div><p>Imprint</p></div></body>", "Title", long, "Short")
    same(f"<body><div><p><a>Home</a></p><p><a>About</a></p></div><div><p>{long}</p><p>{short}</p></div></body>", long, short)
    same(f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{long}</p></article><div class=comments><p>{long}</p><p>{long}</p></div>", "Title", long)
    same(f'<article><p>{long}</p><form><p>Subscribe now.</p></form><div class="ad">Buy, now.</div><p>Ok</p></article>', long, "Ok")
    same(f'<div class="ad">{short}</div><article><h1>One.</h1></article>', "One.")
    same(f'<div class="notice">Cookies, we use them.</div><div><p>{long}</p></div><aside>{short}</aside>', long)


@pytest.mark.parametrize("page", ["<div>x. " * 8000, "<b><p>x. " * 8000, "<span>x. " * 8000 + "</span>" * 8000])
def test_deep_pages_take_linear_time(page):
    begin = time.monotonic()
    assert extract(page).count("x.") == 8000 and time.monotonic() - begin < 1


def test_pages_against_a_plain_parser(spark):
    """Where an article element holds the text, all of it comes out, as the standard library's parser reads it."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.text = False, [""]

        def handle_starttag(self, tag, _):
            self.inside = self.inside or tag == "article"
            if tag in ("p", "h1", "article"):
                self.text.append("")
            elif tag == "br":
                self.text[-1] += " "

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "article"):
                self.text.append("")
            self.inside = self.inside and tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.text[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    got = {r.page_id: r.text for r in extract_pages(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        assert got[r.page_id] == "\n".join(x for x in (" ".join(t.split()) for t in plain.text) if x)


def test_pipeline_mixes_rows_of_one_id(spark):
    import corpus_pipeline

    rows = [(i, "w " * 10, "en", "abc"[k], 1) for k, n in enumerate((60, 3, 3)) for i in [None, 7, 7][: min(n, 3)] * (n // 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(r.source for r in corpus_pipeline.mixed(spark, docs, "").collect())
    want = {r.source: r.n for r in mix(docs).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    assert got == want and sum(got.values()) > 60 * 2 / 3


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "mixing", "packing"]
    rows = [(i, 1) for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now = docs.select(*columns)
    # Repeated rows, rows of one doc_id with different texts, and copies and near copies without one.
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(80))
    odd = [(900, "row of one id " * 9), (900, "row of one id " * 9), (901, f"first {text} end"), (901, "other text of the same id"), (None, f"First {text} end"), (None, f"first {text} END too")]
    now = now.unionByName(spark.createDataFrame([(*r, "en", "a", 1) for r in odd], now.schema))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
        now = spark.createDataFrame(now.collect(), now.schema)
        kept.append([(r.doc_id, r.text) for r in now.collect()])
    assert Counter(kept[0]) == Counter([*pairs(docs), *odd])
    assert len(kept[1]) == len({fold(t) for _, t in kept[1]}) == len({fold(t) for _, t in kept[0]})
    near = [t for _, t in kept[2] if text in (t or "")]
    assert len(near) == 1 and len({t for _, t in kept[2]}) == len(kept[2]) < len(kept[1])
    assert set(kept[3]) <= set(kept[2]) and max(Counter(kept[3]).values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(i for i, _ in kept[3])
