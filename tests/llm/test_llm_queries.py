"""Every registered query of the subpackage against brute force, on the smallest tables and on awkward ones."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import LONG, TEXTS, brute_base, brute_fingerprint, brute_markov, brute_spans

from quillspark.llm import chat, decision_list, decontaminate, gam, kd_shards, link_rank, queries, secrets

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder of tables with null, empty, very long and repeated rows, ties, and columns that clash with the operators' own."""
    d = tmp_path_factory.mktemp("awkward")
    texts = [*TEXTS, None, "", "Hello world", LONG[:50_000], "x" * 50_000, "token = " + "0123456789abcdef" * 3, "a­bᲉ \U0001f642" * 5]
    own = "host string, rule int, trust double, size int, shard int, slot int, stats string, kept int, secrets string, ids int, root int, node int, key string"
    extra = ("h", 1, 0.5, 2, 3, 4, "s", 5, "x", 6, 7, 8, "k")
    rows = [(k // 2 if 4 <= k < 8 else (None if k % 9 == 8 else k), t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "src", None, *extra) for k, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[3]], f"doc_id long, text string, lang string, source string, n_chars long, {own}").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0, "x"), (3, 0, 0, "y"), (3, 0, 0, "y"), (None, 1, 1, "z"), (99, None, None, None)], "doc_id long, quality int, toxic int, features string").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "the cat sat on the mat the cat sat on the mat"), (2, None), (2, ""), (None, "Hello world again and again")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    pages = [(1, "http://a.com/", '<a href="http://b.net/es/">x</a>' * 3), (1, "http://a.com/", None), (2, None, None), (3, "http://b.net/es/x", ""), (None, "", "<a href='//A.COM'>"), (4, "b", "href=http://q.org/")]
    spark.createDataFrame([(*p, "h", 1.0, 2.0, "v") for p in pages], "page_id long, url string, html string, host string, trust double, distrust double, verdict string").write.parquet(f"{d}/pages.parquet")
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (None, 0, "assistant", "</s>"), (3, 1, "assistant", ""), (3, 0, "user", "<image>")]
    spark.createDataFrame([(*t, "c", 5) for t in turns], "conv_id long, turn long, role string, text string, content string, start int").write.parquet(f"{d}/conversations.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == names
    assert sorted(repr([r[n] for n in names]) for r in df.collect()) == sorted(repr([r[columns.index(n)] for n in names]) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_and_awkward_tables(spark, awkward, empty, name):
    n = {"op4_link_rank": 6, "op7_chat": 5, "op2_decontaminate": None, "pipeline": None, "shard_balance": 1}.get(name, len(TEXTS) + 8)
    got = queries.QUERIES[name](spark, awkward).collect()
    assert got and (n is None or len(got) == n)
    none = queries.QUERIES[name](spark, empty).collect()
    assert len(none) == (1 if name in ("op7_chat", "shard_balance") else 0)


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, {}
    for key, text in docs:
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        want[key] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_archive(spark, SF).collect()} == want


def leaks_of(text, items):
    """Items whose best stretch anywhere in the text is within the budget, without pieces."""
    words, out = decontaminate.normal_words(text), {}
    for key, item in items:
        own = decontaminate.normal_words(item)
        if own:
            distance, _ = decontaminate.myers(decontaminate._masks(own), len(own), words)
            if distance <= int(decontaminate.ERROR_RATE * len(own)):
                out[key] = distance
    return out


def test_op2(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got: dict = {}
    for r in queries.op2_decontaminate(spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = r.distance
    for key, text in docs[:: 4 if len(docs) > 100 else 1]:
        assert got.get(key, {}) == leaks_of(text, items)


def features(text):
    """The learner's features in plain Python."""
    n, chars, symbols, dup, repeated, failed = brute_base(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    upper = sum(__import__("unicodedata").category(c) == "Lu" for c in text)
    least, wide = max(n, 1), max(chars, 1)
    values = (chars / least, symbols / least, dup / max(len(lines), 1), repeated / least, upper / wide, sum(c in "0123456789" for c in text) / wide, sum(c in "!?|" for c in text) / least, n / max(len(lines), 1), n)
    return dict(zip(decision_list.FEATURES, values)), failed


def test_op3(spark, docs):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = decision_list.learn_rules(decision_list.labelled_statistics(d, labels))
    got = {r.doc_id: r for r in queries.op3_quality_rules(spark, SF).collect()}
    for key, text in docs:
        row, failed = features(text)
        first = next((k for k, rule in enumerate(rules) if rule.holds(row)), None)
        assert tuple(got[key][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute_base(text)
        assert (got[key].rule, got[key].kept) == (first, not failed and first is None)


def test_op3_rules_find_the_bad_and_leave_the_good(spark):
    """At the scale where few rows are labelled there are rules, and they are right on documents that they did not see."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = decision_list.labelled_statistics(d, labels)
    tp = fp = bad = 0
    for out in range(4):
        rules = decision_list.learn_rules([r for k, r in enumerate(rows) if k % 4 != out])
        assert rules
        said = [(any(rule.holds(r) for rule in rules), r["bad"]) for k, r in enumerate(rows) if k % 4 == out]
        tp, fp, bad = tp + sum(s and b for s, b in said), fp + sum(s and not b for s, b in said), bad + sum(b for _, b in said)
    assert tp >= 0.8 * bad and fp <= 2


def test_op5(spark, docs):
    prints = {k: brute_fingerprint(t) for k, t in docs}
    parent = {k: k for k in prints}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, SF).collect()}
    assert got == {k: (f"{p:016x}", top(k)) for k, p in prints.items()}


def test_op6(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe(spark, SF).collect()}
    for key, text in docs:
        ids = tok.encode(text, add_special_tokens=False).ids
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False).encode())]
        assert got[key] == (len(ids), *digests)


def test_op8(spark, docs):
    got = {r.doc_id: r for r in queries.op8_kd_shards(spark, SF).collect()}
    assert set(got) == {k for k, _ in docs} and {r.law for r in got.values()} == {"bytes"}
    for key, text in docs:
        assert (got[key].size, got[key].text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
    for shard in {r.shard for r in got.values()}:
        slots = sorted(r.slot for r in got.values() if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_tree_against_weighted_medians(spark):
    """Every split against the sorted rows: as near to the goal as a cut between two keys can be, up to the tolerance."""
    rng = random.Random(3)
    rows = [(k, "w" * int(rng.lognormvariate(4, 1)), rng.choice(["en", "de", None]), rng.choice("abcdef")) for k in range(1500)]
    meta = kd_shards._with_keys(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "doc_id", "text", "lang", "source").select("size", *kd_shards.DIMENSIONS)
    held = [tuple(r) for r in meta.collect()]
    total = sum(r[0] for r in held)
    whole = [max(r[d + 1] for r in held) + 1 - min(r[d + 1] for r in held) for d in range(3)]
    tree = kd_shards.build_tree(meta, 13)

    def check(k, rows, box):
        n = tree.nodes[k]
        assert n.weight == sum(r[0] for r in rows)
        if n.left < 0:
            assert n.shards == 1
            return
        assert n.dim == max(range(3), key=lambda d: ((box[d][1] - box[d][0]) / whole[d], kd_shards.DIMENSIONS[d]))
        goal, at, best = n.weight * (n.shards // 2) / n.shards, 0, n.weight
        for _, group in itertools.groupby(sorted(rows, key=lambda r: r[n.dim + 1]), key=lambda r: r[n.dim + 1]):
            best = min(best, abs(goal - at))
            at += sum(r[0] for r in group)
        left = [r for r in rows if r[n.dim + 1] < n.cut]
        assert abs(sum(r[0] for r in left) - goal) <= best + kd_shards.TOLERANCE * total
        lo, hi = box[n.dim]
        check(n.left, left, [*box[: n.dim], (lo, n.cut), *box[n.dim + 1 :]])
        check(n.right, [r for r in rows if r[n.dim + 1] >= n.cut], [*box[: n.dim], (n.cut, hi), *box[n.dim + 1 :]])

    check(0, held, [(min(r[d + 1] for r in held), max(r[d + 1] for r in held) + 1) for d in range(3)])
    placed = meta.select(*kd_shards.DIMENSIONS, tree.node_column().alias("node")).collect()
    for r in placed:
        k = 0
        while tree.nodes[k].left >= 0:
            n = tree.nodes[k]
            k = n.left if r[n.dim] < n.cut else n.right
        assert r.node == k


def test_log_odds_against_counts(spark):
    """The models' table from plain counts."""
    samples = [(r["sample"], r.is_random) for r in secrets.labelled_samples(spark, 300).collect()]
    size = len(secrets.ALPHABET) + 1
    counts = {True: np.full((size, size), 0.5), False: np.full((size, size), 0.5)}
    for x, label in samples:
        codes = [secrets.ALPHABET.find(c) + 1 for c in x]
        for a, b in itertools.pairwise(codes):
            counts[label][a, b] += 1
    want = sum(sign * np.log(counts[label] / counts[label].sum(axis=1, keepdims=True)) for label, sign in ((True, 1), (False, -1)))
    assert np.allclose(np.array(secrets.train(secrets.labelled_samples(spark, 300))).reshape(size, size), want)


def test_op9(spark, docs):
    odds = secrets.train(secrets.labelled(spark.read.parquet(f"{SF}/documents.parquet")))
    got = {r.doc_id: r for r in queries.op9_secrets(spark, SF).collect()}
    for key, text in docs:
        base = brute_spans(text)
        every = sorted(base + brute_markov(text, odds))
        told = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        n = Counter(k for _, k, _ in base)
        assert (got[key].n_assign, got[key].n_access, got[key].n_hex) == (n[0], n[1], n[2])
        assert got[key].base_sha256 == hashlib.sha256(told(base).encode()).hexdigest() and got[key].spans == told(every)


def brute_score(model, row):
    total = model.intercept
    for f, table in enumerate(model.tables):
        total += table[sum(e < row[f] for e in model.edges[f])]
    for (a, b), table in zip(model.pairs, model.pair_tables):
        total += table[sum(e < row[a] for e in model.coarse[a]), sum(e < row[b] for e in model.coarse[b])]
    return 1 / (1 + np.exp(-total))


def test_op10(spark, docs):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = gam.train(d, labels, usable=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    got = {r.doc_id: r for r in queries.op10_quality_gam(spark, SF).collect()}
    for key, text in docs:
        score = brute_score(model, gam.text_features(text))
        assert abs(got[key].score - score) < 1e-9 and got[key].predicted == int(score >= 0.7)
        assert got[key].held_out == (zlib.crc32(str(key).encode()) % 4 == 2)


def test_pipeline(spark, docs):
    """The five stages in plain Python over the rows that the one before keeps."""
    from tokenizers import Tokenizer

    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = gam.train(d, labels)
    kept = [(k, t) for k, t in docs if brute_score(model, gam.text_features(t)) >= 0.7]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for _, t in kept]
    parent = list(range(len(kept)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(kept)), 2):
        union = len(sets[a] | sets[b])
        if not union or 5 * len(sets[a] & sets[b]) >= 4 * union:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    kept = [kept[k] for k in range(len(kept)) if top(k) == k]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(k, t) for k, t in kept if not leaks_of(t, items)]
    odds = secrets.train(secrets.labelled(spark.createDataFrame(kept, "doc_id long, text string")))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for key, text in kept:
        out, at = "", 0
        for a, _, b in sorted(brute_spans(text) + brute_markov(text, odds)):
            if a > at or not out and not at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        want[key] = tok.encode(out + text[at:], add_special_tokens=False).ids
    assert {r.doc_id: r.ids for r in queries.pipeline(spark, SF).collect()} == want


def test_chat_parts_can_not_forge(spark):
    """Control strings split over parts at every place come back as the same turns, parts and attachments."""
    rng = random.Random(21)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "<image>", "<audio>", "<\\/s>", "<", "[", "\\", "/", "s>", "é", " ok "]
    rows, want = [], {}
    for conv in range(150):
        turns = []
        for turn in range(rng.randint(1, 3)):
            whole, parts = "".join(rng.choice(bits) for _ in range(rng.randint(0, 5))), []
            while whole:  # cut anywhere, attachments between some of the pieces
                n = rng.randint(1, 4)
                parts.append(("text", whole[:n], None, None))
                whole = whole[n:]
                if rng.random() < 0.2:
                    parts.append((rng.choice(["image", "audio", "document"]), "ignored", f"r{len(rows)}", rng.choice([None, 0, 3])))
                if rng.random() < 0.1:
                    parts.append(("text", None, None, None))
            role = rng.choice(["user", "assistant"])
            rows.append((conv, turn, role, parts))
            met = []
            for kind, text, _, _ in parts:
                if kind == "text" and met and met[-1][0] == "text":
                    met[-1] = ("text", met[-1][1] + (text or ""))
                else:
                    met.append((kind, (text or "") if kind == "text" else None))
            turns.append((role, [m for m in met if m != ("text", "")], [p[2] for p in parts if p[0] != "text"]))
        want[conv] = turns
    table = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>")
    out = chat.format_conversations(table).select("*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("lost"))
    for r in out.collect():
        turns = want[r.conv_id]
        assert [(t.role, [tuple(p) for p in t.parts]) for t in r.turns] == [(role, parts) for role, parts, _ in turns]
        assert [a.ref for a in r.attachments] == [ref for _, _, refs in turns for ref in refs]
        text = lambda parts: "".join(x if kind == "text" else f"<{kind}>" for kind, x in parts)
        assert r.lost == "".join(text(parts) for role, parts, _ in turns if role == "assistant")


def test_rows_that_share_or_lack_an_id_are_judged_alone(spark):
    item = "which large lake is the deepest of all the lakes of this wide world"
    rows = [(None, f"x {item} y"), (None, "clean text of some words"), (7, f"{item}"), (7, "another clean text"), (8, ""), (8, None)]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("i", item), ("j", "no such words here")], "item_id string, text string"), block_chars=10)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[1], rows[3], rows[4], rows[5]])
    found = decontaminate.find_leaks(spark.createDataFrame([("a", rows[0][1])], "doc_id string, text string"), spark.createDataFrame([("i", item)], "item_id string, text string"))
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [("a", "i")]


def test_a_thousand_linked_hosts(spark):
    """Trust and distrust with production values against power iteration, and the verdicts that follow."""
    rng = random.Random(17)
    names = [f"h{k}.org" for k in range(1000)]
    good, bad = [f"g{k}.com" for k in range(20)], [f"b{k}.net" for k in range(20)]
    onward = [(names[k], names[min(999, k + rng.randint(1, 250))]) for k in range(999) for _ in range(3)]
    links = {*onward, *((g, rng.choice(names)) for g in good for _ in range(5)), *((a, rng.choice(bad)) for a in rng.sample(names, 100))}
    hosts = [*names, *good, *bad]
    rows = [(k, f"http://{h}/es/", "".join(f"<a href='http://{b}/x'>" for a, b in sorted(links) if a == h)) for k, h in enumerate(hosts)]
    rules = [("allow", "com/"), ("block", "net/es/")]
    got = {r.host: r for r in link_rank.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}

    def ranks(edges, seeds):
        place = {h: k for k, h in enumerate(hosts)}
        out = [sorted({place[b] for a, b in edges if a == h}) for h in hosts]
        start = np.array([1 / len(seeds) if h in seeds else 0.0 for h in hosts])
        r = start.copy()
        for _ in range(200):
            new = 0.15 * start + 0.85 * start * sum(r[k] for k in range(len(hosts)) if not out[k])
            for k, to in enumerate(out):
                for b in to:
                    new[b] += 0.85 * r[k] / len(to)
            r = new
        return r

    trust, distrust = ranks(links, set(good)), ranks({(b, a) for a, b in links}, set(bad))
    ranked = sum((trust > 0) | (distrust > 0))
    for k, h in enumerate(hosts):
        assert abs(got[h].trust - trust[k]) < 1e-7 and abs(got[h].distrust - distrust[k]) < 1e-7
        if abs(distrust[k] - trust[k]) > 1e-6:
            assert got[h].verdict == ("allow" if h in good or h not in bad and distrust[k] - trust[k] <= link_rank.THRESHOLD / ranked else "block")
    assert Counter(r.verdict for r in got.values())["block"] > 120


def test_bounded_memories(spark, monkeypatch):
    """Encoders whose memory is all but nothing, and texts that no memory would pay for, encode as before."""
    from tokenizers import Tokenizer

    from quillspark.llm import bpe, token_archive

    rng = random.Random(5)
    texts = [t or "" for t in TEXTS] + [" ".join("".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(60)) for _ in range(40)] + ["文" * 3000, "日本語 " * 50, "ab " * 400]
    wide = [chr(c) for c in (0x1C89, 0xA7CB, 0x558, 0x1F9FF, 0x0CDD, 0x1E030, 0x11F04, 0x31350, 0x10D50, 0x16D43, 0x378)]
    texts += ["".join(rng.choice([*wide, "a", " ", "'s", "1", "Σ", "ς", "　", "\x1c"]) for _ in range(30)) for _ in range(300)]
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3000)
    monkeypatch.setattr(token_archive, "CACHE_BYTES", 3000)
    own, tok = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):
        for k in range(0, len(texts), 25):
            for t, (ids, decoded) in zip(texts[k : k + 25], own.encode_many(texts[k : k + 25])):
                want = tok.encode(t, add_special_tokens=False).ids
                assert np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == tok.decode(want, skip_special_tokens=False)
            assert own.held <= 3000
    chunks, tok = token_archive.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), 2), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for share in (0.4, 2.0, -1.0):
        monkeypatch.setattr(token_archive, "NEW_SHARE", share)
        for k in range(0, len(texts), 25):
            for t, ids in zip(texts[k : k + 25], chunks.encode_many(texts[k : k + 25])):
                assert np.frombuffer(ids, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids
            assert chunks.held <= 3000


def test_segment_trees_merge_long_words_alike():
    from quillspark.llm import bpe

    own, rng = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")), random.Random(8)
    for n in (1, 2, 3, 31, 47, 48, 49, 64, 200):
        words = ["".join(rng.choice("thearnsié!") for _ in range(n)) for _ in range(30)]
        symbols = {w: [own.inner[b] for b in w.encode()[:-1]] + [own.final[w.encode()[-1]]] for w in words}
        for size in {len(s) for s in symbols.values()}:
            some = [w for w in words if len(symbols[w]) == size]
            got = own.trees.merged(np.array([symbols[w] for w in some], np.int64))
            assert [[x for x in row if x >= 0] for row in got.tolist()] == [own.word(w) for w in some]


def test_characters_known_alike():
    """Every character that takes the quick way, alone, in a word and beside a digit."""
    from tokenizers import Tokenizer

    from quillspark.llm import bpe

    place = public_tokenizers.path("word_bpe_49k.json")
    own, tok = bpe.WordBpe(place), Tokenizer.from_file(place)
    quick = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not own.strange.search(chr(c)) and not 0x4E80 <= c < 0x9F80]
    texts = [f"a{c}b {c}1 {c}" for c in quick]
    for (ids, _), want in zip(own.encode_many(texts), tok.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids


def test_shared_folder_must_be_named(spark):
    from quillspark import shared

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    assert shared.shared_dir(Session(spark_master="local[4]")) == shared.LOCAL_DEFAULT
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session(spark_master="spark://host:7077"))
