"""The training-data operators against brute force, on small tables with every awkward row."""

import array
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, components, decision_list, decontaminate, gam, kd_shards, link_rank, near_copies, secrets, simhash, store, token_archive

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, stats string, extra int"
LONG = " ".join(f"w{k % 977}" for k in range(20_000))
TEXTS = [
    None, "", "   \n\t ", "a", "Hello world", "Hello world", "the cat sat on the mat " * 30, LONG, "one\n\ntwo\n\none\n x ", "naïve café — ΟΔΟΣ 日本語 🙂🙂",
    "tab\tsep  double  spaces\x0b\x0c end ", "<|endoftext|> a <|startoftext|>b", "password = hunter2hunter2 and token: abc", "x" * 5000,
]


def docs_of(spark, texts=TEXTS, schema=SCHEMA):
    rows = [(k, t, None if k % 5 == 0 else "en", "s" if k % 3 else None, None if t is None else len(t), "clash", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def awkward(spark):
    """All texts, with a repeated row and a null id."""
    d = docs_of(spark)
    return d.unionByName(d.where("doc_id = 4")).unionByName(d.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))


# ---- token archive


def test_archive_round_trip(spark):
    path, place = store.fresh_path(spark, "a"), public_tokenizers.path("byte_bpe_50k.json")
    docs = awkward(spark)
    token_archive.write_archive(docs, path, place, end_id=2, shards=3)
    got = token_archive.read_archive(spark, path).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(place)
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or ""), r.doc_id, r.text or "") for r in docs.collect())
    start, want = 0, []
    for _, key, text in order:
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        want.append((key, start, len(ids), ids))
        start += len(ids)
    assert sorted(((r.doc_id is not None, r.start), r.doc_id, r.n_tokens, list(array.array("I", r.ids))) for r in got) == sorted(((w[0] is not None, w[1]), w[0], w[2], w[3]) for w in want)
    assert token_archive.read_document(spark, path, 7) == [w[3] for w in want if w[0] == 7]
    assert len(token_archive.read_document(spark, path, 4)) == 2 and token_archive.read_document(spark, path, 99) == []
    crc = token_archive.read_archive(spark, path, {"c": ("long", zlib.crc32)}).where("doc_id = 7").first()
    assert crc.c == zlib.crc32(np.array([w[3] for w in want if w[0] == 7][0], "<u4").tobytes())


def test_archive_of_nothing(spark):
    path = store.fresh_path(spark, "a")
    token_archive.write_archive(docs_of(spark, []), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_archive.read_archive(spark, path).count() == 0


def test_blocks_refuse_other_dictionaries():
    block = token_archive.pack_block(hashlib.sha256(b"one").digest(), 2, [])
    with pytest.raises(ValueError):
        list(token_archive.unpack_block(block, b"two"))


# ---- decontamination


def brute_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        prev, row[0] = row[:], i
        for j, v in enumerate(words, 1):
            row[j] = min(prev[j - 1] + (w != v), prev[j] + 1, row[j - 1] + 1)
    return min(row)


def test_myers_and_pieces_against_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        item = [rng.choice("abcde") for _ in range(rng.randint(1, 12))]
        words = [rng.choice("abcdef") for _ in range(rng.randint(0, 30))]
        best, _ = decontaminate.myers(decontaminate._masks(item), len(item), words)
        assert best == brute_distance(item, words)
        budget = len(item) // 5
        found = decontaminate.Matcher([(1, " ".join(item))], 0.2).match(" ".join(words))
        assert bool(found) == (brute_distance(item, words) <= budget)
        if found:
            _, _, _, distance, a, b = found[0]
            assert brute_distance(item, words[a:b]) == distance == best


def test_leaks(spark):
    item = "What is the boiling point of pure water at sea level in degrees"
    edited = item.replace("pure ", "very pure ").upper()
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "???"), (5, "entirely other words that nobody wrote down here")], "item_id long, text string")
    docs = docs_of(spark, [None, "", f"lead in {item} and out", f"x {edited}!! y", "What is the point of it all", LONG + " " + item])
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(2, 1): 0, (3, 1): 1, (5, 1): 0}
    blocks = decontaminate.find_leaks(docs, items, block_chars=10).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == set(got)
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), items).count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 4] and kept.columns == docs.columns


# ---- quality rules


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark):
    rng = random.Random(3)
    texts = [*TEXTS, *(" ".join(rng.choice(["a", "b", "c", "#", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(60))]
    texts += [" ".join(map(str, range(30))), " ".join(map(str, [*range(9), *range(9), *range(100, 130)]))]
    got = decision_list.judge(docs_of(spark, texts), []).select("doc_id", "stats.*", "kept").collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed)
    assert decision_list.judge(docs_of(spark, []), []).count() == 0


def test_learned_rules(spark):
    rng = random.Random(1)
    rows = [{f: rng.random() for f in decision_list.FEATURES} for _ in range(900)]
    for r in rows:
        r["bad"] = r["upper_rate"] > 0.8 or (r["symbol_rate"] > 0.6 and r["mark_rate"] < 0.3)
    rules = decision_list.learn_rules(rows)
    wrong = sum(any(rule.holds(r) for rule in rules) != r["bad"] for r in rows)
    assert rules and wrong <= 30
    assert decision_list.learn_rules([]) == [] and decision_list.learn_rules([r | {"bad": False} for r in rows]) == []
    # the best cut against every cut
    few = decision_list._Table(rows[:60])
    for f, name in enumerate(decision_list.FEATURES):
        values, best = sorted({r[name] for r in rows[:60]}), 0.0
        for low, high in itertools.pairwise(values):
            for above in (False, True):
                side = [r["bad"] for r in rows[:60] if (r[name] > (low + high) / 2) == above]
                if any(side):
                    best = max(best, sum(side) * (math.log2(sum(side) / len(side)) - math.log2(sum(r["bad"] for r in rows[:60]) / 60)))
        cut = few.best_test(np.ones(60, bool), f)
        side = [r["bad"] for r in rows[:60] if cut.holds(r)]
        assert abs(sum(side) * (math.log2(sum(side) / len(side)) - math.log2(sum(r["bad"] for r in rows[:60]) / 60)) - best) < 1e-9
    # few bad rows, and a first feature that misleads, still give rules that hold on unseen rows
    for seed in range(5):
        rng = random.Random(seed)
        small = [{f: rng.random() for f in decision_list.FEATURES} for _ in range(400)]
        for r in small:
            kind = rng.random()
            r["bad"] = kind < 0.14
            if r["bad"]:
                r["dup_line_rate" if kind < 0.07 else "digit_rate"] = 2 + rng.random()
        found = decision_list.learn_rules(small[:300])
        said = [any(rule.holds(r) for rule in found) for r in small[300:]]
        assert len(found) == 2 and said == [r["bad"] for r in small[300:]]
    row = spark.createDataFrame([{"stats": {f: rows[0][f] for f in decision_list.FEATURES}}], "stats struct<" + ",".join(f"{f}: double" for f in decision_list.FEATURES) + ">")
    assert row.select(rules[0].column(F.col("stats")).alias("x")).first().x == rules[0].holds(rows[0])


# ---- link graph


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://Www.Example.COM/en/x?q#f", "https://a.b.net/es/1", "x://net/fr/", "http://EXAMPLE.com", "http://example.com/en/", "ftp://notcom/", "http://h?x/y", "http://h#f/en"]
    rows = [(k, u, "<a href='http://z/'>") for k, u in enumerate(urls)]
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    got = {r.page_id: r for r in link_rank.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if c.isascii() else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [r for r in rules if (host == (h := r[1].split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r[1].split("/", 1)[1])]
        best = max(fits, key=lambda r: len(r[1]), default=None)
        return host, path, best and best[1], best and best[0]

    for k, u in enumerate(urls):
        host, path, rule, verdict = brute(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert verdict is None or got[k].verdict == verdict
    assert got[0].verdict == "allow"
    assert link_rank.judge_pages(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


def test_propagation_against_power_iteration(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "d"), ("e", "d"), ("d", "f")]
    got = {r.node: r["rank"] for r in link_rank.propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a", 1.0), ("e", 1.0)], "node string, weight double"), rounds=60).collect()}
    nodes = sorted({n for e in edges for n in e})
    seed = np.array([0.5 if n in "ae" else 0.0 for n in nodes])
    out = {n: sorted({b for a, b in edges if a == n}) for n in nodes}
    r = seed.copy()
    for _ in range(200):
        new = 0.15 * seed + 0.85 * seed * sum(r[i] for i, n in enumerate(nodes) if not out[n])
        for i, n in enumerate(nodes):
            for b in out[n]:
                new[nodes.index(b)] += 0.85 * r[i] / len(out[n])
        r = new
    assert all(abs(got.get(n, 0.0) - r[i]) < 1e-5 for i, n in enumerate(nodes))


def test_distrust_reaches_those_who_link_to_the_blocked(spark):
    pages = [(1, "http://bad.net/es/", ""), (2, "http://friend.org/x", '<a href="http://bad.net/es/">'), (3, "http://clean.org/", '<a href="//good.com/">'), (4, "http://good.com/", "")]
    rules = [("allow", "com/"), ("block", "net/es/")]
    got = {r.page_id: r.verdict for r in link_rank.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_verdicts_do_not_hang_on_graph_size_or_depth(spark):
    rules = [("allow", "com/"), ("block", "net/es/")]
    pages = []
    for k in range(40):
        pages += [(k, f"http://bad{k}.net/es/", ""), (100 + k, f"http://friend{k}.org/", f'<a href="http://bad{k}.net/es/">')]
    for many in (1, 40):
        some = [p for p in pages if p[0] % 100 < many]
        judged = link_rank.judge_pages(spark.createDataFrame(some, "page_id long, url string, html string"), rules, threshold=0.05)
        assert {r.verdict for r in judged.collect()} == {"block"}
    chain = [(f"h{k}", f"h{k + 1}") for k in range(34)]
    got = link_rank.propagate(spark.createDataFrame(chain, "src string, dst string"), spark.createDataFrame([("h0", 1.0)], "node string, weight double"))
    ranks = {r.node: r["rank"] for r in got.collect()}
    want = 0.85**34 / sum(0.85**k for k in range(35))
    assert len(ranks) == 35 and abs(ranks["h34"] - want) < 1e-9


# ---- SimHash


def brute_fingerprint(text):
    import xxhash

    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    for t in TEXTS[:-1]:
        assert simhash.text_fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize(("radius", "bucket"), [(2, 32), (2, 1), (1, 32), (1, 1), (3, 32), (3, 2), (0, 32)])
def test_links_and_components_against_brute_force(spark, monkeypatch, radius, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), radius)
    root = {r.node: r.root for r in components.connected_components(links).collect()}
    parent = {p: p for p in signed}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    assert all(root.get(p, p) == top(p) for p in signed)


def test_near_duplicate_classes(spark):
    got = simhash.near_duplicate_classes(awkward(spark)).collect()
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert len(got) == len(TEXTS) + 2
    assert of[0] == of[1] == of[2] == 0 and of[4] == of[5] == 4 and of[3] == 3
    assert simhash.near_duplicate_classes(docs_of(spark, [])).count() == 0


def test_long_chain_is_one_component(spark):
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert components.connected_components(chain).groupBy("root").count().collect()[0]["count"] == 301


# ---- near copies


def test_pipeline_near_copies_against_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(11)
    texts = [None, "", "  ", "a b", "A  b", "a c"]
    for n in (12, 30, 60, 120, 300):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (1, 1, 2, 3, 6):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(n)] = f"x{rng.randrange(5000)}"
                texts.append(" ".join(copy))
    # a crowd whose members are some of them near, others not, and a passage that makes half of unrelated texts
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    for k in range(60):
        copy = list(base)
        for _ in range(k // 6):
            copy[rng.randrange(100)] = f"y{rng.randrange(5000)}"
        texts.append(" ".join(copy))
        texts.append(" ".join(base[:50] + [f"z{rng.randrange(50000)}" for _ in range(rng.randrange(50))]))
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    parent = list(range(len(texts)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    near = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        union = len(sets[a] | sets[b])
        if not union or 5 * len(sets[a] & sets[b]) >= 4 * union:
            near += sets[a] != sets[b]
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    assert near > 50
    kept = corpus_pipeline.near_duplicates(spark, docs_of(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == [k for k in range(len(texts)) if top(k) == k]
    assert kept.columns == docs_of(spark).columns


def test_near_copies_are_chosen_by_row(spark):
    rows = [(None, "one text of its own"), (None, "another text of its own"), (1, "third text"), (1, "fourth words"), (2, "third text"), (1, "third text")]
    kept = near_copies.keep_first_of_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([*rows[:4]])
    assert near_copies.keep_first_of_similar(docs_of(spark, [])).count() == 0


# ---- BPE


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    place = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(place), bpe.WordBpe(place)
    rng = random.Random(2)
    letters = [chr(c) for c in [*range(1, 700), 0x1F600, 0x4E2D, 0x301, 0x2028, 0x130, 0x3A3, 0xFEFF]]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters) if rng.random() < 0.4 else rng.choice("abeST '\n") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    for t, (ids, text) in zip(texts, own.encode_many(texts)):
        want = tok.encode(t, add_special_tokens=False).ids
        assert list(array.array("I", ids)) == want and text.decode() == tok.decode(want, skip_special_tokens=False) and own.decode(ids) == text
    rows = bpe.encode_texts(awkward(spark), place, carry=("lang",), as_array=True).collect()
    assert len(rows) == len(TEXTS) + 2
    assert all(r.ids == tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids for r in rows if r.doc_id is not None)
    assert bpe.encode_texts(docs_of(spark, []), place).count() == 0


def test_workers_hold_little_unused_after_a_task(spark):
    def held(batches):  # MB that a worker could return, after a task of this query
        import pathlib

        import pyarrow as pa

        mb = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
        for b in batches:
            before = mb()
            store.give_back()
            yield pa.RecordBatch.from_arrays([pa.array([before - mb()])], names=["mb"])

    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(499)), lambda k: F.concat(F.lit("word"), (F.col("id") * 7 + k) % 3000)))
    docs = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"))
    bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json")).agg(F.sum("n_tokens")).collect()
    assert max(r.mb for r in spark.range(0, 4, 1, 4).select("id").mapInArrow(held, "mb double").collect()) < 16


def test_both_segment_trees_merge_alike():
    own = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    words = {"".join(rng.choice("thearnsé") for _ in range(rng.randint(1, 30))) for _ in range(400)}
    assert own.word_many(list(words)) == {w: array.array("I", own.word(w)).tobytes() for w in words}


# ---- chat


def test_escapes_are_reversible(spark):
    rng = random.Random(6)
    bits = ["<", "[", "\\", "/", "s>", "INST]", "image>", "</s>", "[/INST]", "<s>", " ok "]
    texts = ["", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(400))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in rows.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(m in r.e for m in ("<s>", "</s>", "[INST]", "[/INST]", "<image>"))


def test_conversations(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 2, "assistant", [part("text", "b</s>")]), (1, 1, "user", [part("text", "see "), part("image", ref="p.png", units=2), part("text", " and "), part("audio", ref="a.wav", units=10)]),
        (1, 3, "assistant", [part("text", "<"), part("text", "s>")]), (2, 1, None, None), (2, 1, None, None), (3, 1, "assistant", [part("text", None)]), (None, 0, "user", [part("document", ref="d")]),
    ]
    t = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>")
    out = chat.format_conversations(t)
    got = {r.conv_id: r for r in out.select("*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("lost")).collect()}
    assert [(x.role, x.content) for x in got[1].turns] == [("user", "see <image> and <audio>"), ("assistant", "b</s>"), ("assistant", "<s>")]
    assert got[1].lost == "b</s><s>" and [(a.kind, a.ref, a.tokens) for a in got[1].attachments] == [("image", "p.png", 512), ("audio", "a.wav", 250)] and got[1].n_tokens == 762
    assert [(x.role, x.content) for x in got[2].turns] == [("", ""), ("", "")] and got[3].lost == "" and got[None].n_tokens == 512
    assert chat.format_conversations(t.limit(0)).count() == 0


# ---- k-d shards


def test_shards(spark):
    rng = random.Random(8)
    texts = ["same text"] * 300 + ["word " * rng.randint(1, 60) for _ in range(500)] + [None, ""]
    docs = docs_of(spark, texts)
    path = store.fresh_path(spark, "s")
    kd_shards.write_shards(docs, path, shards=7)
    rows = kd_shards.read_shards(spark, path).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted(((k, t) for k, t in enumerate(texts)), key=lambda x: x[0])
    for shard in range(7):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += len((r.text or "").encode()) + 16
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) < 4 * 320
    path = store.fresh_path(spark, "s")
    kd_shards.write_shards(docs_of(spark, []), path, shards=3)
    assert kd_shards.read_shards(spark, path).count() == 0
    meta = kd_shards._with_keys(docs, "doc_id", "text", "lang", "source")
    tree = kd_shards.build_tree(meta, 1, target_bytes=10_000)
    assert tree.shards == len(tree.leaves()) == -(-sum(sizes.values()) // 10_000)


# ---- secrets


def brute_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def brute_markov(text, odds):
    """Candidates judged whole, then by windows, in plain loops."""
    size = len(secrets.ALPHABET) + 1

    def mean(x):
        codes = [secrets.ALPHABET.find(c) + 1 for c in x]
        return sum(odds[a * size + b] for a, b in itertools.pairwise(codes)) / (len(codes) - 1)

    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        x, hit = m[0], set()
        if mean(x) > secrets.THRESHOLD:
            out.append((m.start(), 3, m.end()))
            continue
        for i in range(len(x) - 19):
            if mean(x[i : i + 20]) > secrets.THRESHOLD:
                hit.add(i)
        spans = []
        for i in sorted(hit):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + 20
            else:
                spans.append([i, i + 20])
        wide = []
        for a, b in spans:
            while a > 0 and x[a - 1] not in "=/_-":
                a -= 1
            while b < len(x) and x[b] not in "=/_-":
                b += 1
            if wide and a <= wide[-1][1]:
                wide[-1][1] = max(b, wide[-1][1])
            else:
                wide.append([a, b])
        out += [(m.start() + a, 3, m.start() + b) for a, b in wide]
    return sorted(out)


def test_secrets(spark):
    odds = secrets.train(secrets.labelled_samples(spark))
    rng = random.Random(9)
    bits = ["token", "PASSWD", "api_key", "apikey", " = ", ":", '"', "abcdefgh", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é🙂", " ", "secret", "xyz"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    odd = ["9fK2", "Zq7X", "listing", "name", "=", "/", "_", "-", "reference", "8hQ", "0zR4v"]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(8, 40))) + " x" for _ in range(150)]
    texts.append("key 9233A8ECF7C5B09FE5949719B6B82BC439E9329B or getUserAccountBalanceHistory and keitstlichschenverpf")
    found = {r.doc_id: [tuple(s)[:3] for s in r.secrets] for r in secrets.find_secrets(docs_of(spark, texts), odds).collect()}
    for k, t in enumerate(texts):
        assert [s for s in found[k] if s[1] < 3] == brute_spans(t), t
        more = [s for s in found[k] if s[1] == 3]
        assert more == brute_markov(t, odds), t
    last = texts[-1]
    assert [last[a:b] for a, _, b in found[len(texts) - 1]] == ["9233A8ECF7C5B09FE5949719B6B82BC439E9329B"]
    clean = {r.doc_id: r.text for r in secrets.redact(secrets.find_secrets(docs_of(spark, texts), odds)).collect()}
    assert clean[len(texts) - 1] == last.replace("9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "[SECRET]") and clean[0] in (None, "") and clean[4] == "Hello world"
    assert secrets.find_secrets(docs_of(spark, []), odds).count() == 0


def test_models_learn_from_documents(spark):
    """Models of one half of the documents find what the fixed patterns find in the other, and leave the rest alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang <> 'x'")
    side = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))
    train, test = docs.where(side == 0), docs.where(side == 1)
    odds = secrets.train(secrets.labelled(train))
    samples = secrets.labelled_texts(test, rows=10**9).where(F.length("sample") >= secrets.CANDIDATE_LEAST).distinct()
    judged = samples.select("is_random", (secrets.log_odds(F.col("sample"), odds) > secrets.THRESHOLD).alias("said"))
    right = {r.is_random: (r.a, r.n) for r in judged.groupBy("is_random").agg(F.avg((F.col("said") == F.col("is_random")).cast("int")).alias("a"), F.count("*").alias("n")).collect()}
    assert right[True][1] > 40 and right[True][0] > 0.95 and right[False][1] > 10 and right[False][0] > 0.99
    found = secrets.find_secrets(test, odds).select(F.explode("secrets").alias("s"), "text").select("s.*", F.substring("text", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")).alias("said"))
    kinds = {r.kind: r["count"] for r in found.groupBy("kind").count().collect()}
    assert kinds["markov"] > 0.95 * kinds["assign"]
    assert secrets.labelled_texts(docs_of(spark, []), rows=5).count() == 0


def test_long_texts_with_many_spans(spark):
    """Work that grew with the square of the matches would not end here."""
    rng = random.Random(13)
    value = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    texts = [" ".join(f"token = {value()}" for _ in range(20_000)), "_".join(rng.choice(["reference", "9fK2Zq7X0aB5cD3eF1gH"]) for _ in range(4_000))]
    odds = secrets.train(secrets.labelled_samples(spark))
    found = secrets.find_secrets(docs_of(spark, texts), odds)
    got = {r.doc_id: r for r in secrets.redact(found).select("doc_id", "text", "secrets").collect()}
    assert [tuple(s)[:3] for s in got[0].secrets if s[1] < 3] == brute_spans(texts[0])
    assert got[0].text == "[SECRET] " * 19_999 + "[SECRET]"
    assert "9fK2" not in got[1].text and "reference" in got[1].text


def test_markov_models_tell_held_out_samples_apart(spark):
    samples = secrets.labelled_samples(spark, 1200).withColumn("h", F.pmod(F.xxhash64("sample"), F.lit(4)))
    odds = secrets.train(samples.where("h > 0"))
    held = samples.where("h = 0 and length(sample) >= 20").select("is_random", (secrets.log_odds(F.col("sample"), odds) > secrets.THRESHOLD).alias("said"))
    right = {r.is_random: r.a for r in held.groupBy("is_random").agg(F.avg((F.col("said") == F.col("is_random")).cast("int")).alias("a")).collect()}
    assert right[True] > 0.93 and right[False] > 0.99


def test_secrets_joined_to_names_and_paths(spark):
    odds = secrets.train(secrets.labelled_samples(spark))
    rng = random.Random(12)
    letters = secrets.ALPHABET[:62]
    before = ["", "aws_secret_access_key=", "client_secret_value=", "https://hooks.example.org/services/integrations/hooks/"]
    after = ["", "/callback/handler", "_production_environment_value"]
    cases = [(b, "".join(rng.choice(letters) for _ in range(n)), a) for b in before for a in after for n in (20, 24, 32, 40) for _ in range(25)]
    docs = docs_of(spark, [f"see {b}{x}{a} there" for b, x, a in cases])
    clean = {r.doc_id: r.text for r in secrets.redact(secrets.find_secrets(docs, odds)).collect()}
    for n, least in ((20, 0.95), (24, 0.98), (32, 0.99), (40, 0.99)):
        of = [k for k, c in enumerate(cases) if len(c[1]) == n]
        gone = [not any(cases[k][1][i : i + 6] in clean[k] for i in range(n - 5)) for k in of]
        assert sum(gone) >= least * len(of)
    words = secrets.IDENTIFIER_WORDS
    plain = ["".join(rng.choice(words) + rng.choice("/_-=") for _ in range(rng.randint(3, 12))) for _ in range(600)]
    found = secrets.find_secrets(docs_of(spark, plain), odds).where(F.exists("secrets", lambda s: s["kind"] == "markov")).count()
    assert found <= 6
    # two secrets of one run: parts next to them may go too, those further off stay
    two = f"first_value={'9fK2' * 6}/ordinary/directory/listing/reference/{'Zq7X' * 6}"
    spans = secrets.find_secrets(docs_of(spark, [two]), odds).first().secrets
    assert all(a.stop < b.start for a, b in itertools.pairwise(spans)) and "listing" in "".join(two[a.stop : b.start] for a, b in itertools.pairwise(spans))


# ---- quality model


def test_gam(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs and np.mean((model.score(x[2000:]) > 0.5) == y[2000:]) > 0.95
    assert 0 < gam.fit(np.zeros((0, len(gam.FEATURES))), np.zeros(0)).score(x[:1])[0] < 1
    docs = awkward(spark)
    scored = gam.score_texts(docs, model).collect()
    assert len(scored) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in scored)
    kept = gam.keep_good(docs, gam.Gam(5.0))
    assert kept.columns == docs.columns and kept.count() == docs.count() and gam.keep_good(docs, gam.Gam(-5.0)).count() == 0
    assert gam.score_texts(docs_of(spark, []), model).count() == 0
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(TEXTS))] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert gam.train(docs, labels.limit(0)).tables == [] and len(gam.train(docs, labels).tables) == len(gam.FEATURES)


def test_gam_separates_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = gam.train(docs, labels, usable=~held)
    said = gam.score_texts(docs, model).join(labels, "doc_id").where(held).select(((F.col("score") >= 0.7).cast("int") == F.col("quality")).alias("right"))
    assert said.agg(F.avg(F.col("right").cast("int"))).first()[0] > 0.93


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = store.save(stage(spark, seen, d), name)
        assert out.columns == docs.columns and 0 < out.count() <= seen.count()
        seen = out
    last = corpus_pipeline.STAGES[-1][1](spark, seen, d)
    assert last.count() == seen.count()
    assert decontaminate.find_leaks(seen, spark.read.parquet(f"{d}/benchmark.parquet")).count() == 0
