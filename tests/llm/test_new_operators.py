"""Merkle multiproofs, SentencePiece rounds, spelling variants and the restarted rollup against brute force, and on awkward inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annoweave.llm import merkle, packing, sentence_pieces, spelling, token_counts
from annoweave.llm import entry as llm
from test_llm import AWKWARD, SCHEMA, docs_of


@pytest.fixture(scope="module")
def awkward(spark):
    df = docs_of(spark, AWKWARD, [None if i % 4 == 0 else f"s{i % 3}" for i in range(len(AWKWARD))])
    lost = df.filter("doc_id in (4, 8)").withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string"))
    return df.unionByName(df.filter("doc_id = 4")).unionByName(lost).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# -- op11


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def way(levels, i):
    for nodes in levels[:-1]:
        first = i // 8 * 8
        yield nodes[first:i], nodes[i + 1 : first + 8]
        i //= 8


def brute_proofs(rows):
    trees = {}
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted([((r[0] is not None, r[0] or 0, brute_leaf(r)), r) for r in rows if r[2] == lang], key=lambda x: x[0])
        trees[lang] = own, brute_tree([k[2] for k, _ in own])
    top = brute_tree([levels[-1][0] for _, levels in trees.values()])
    out = []
    for k, (own, levels) in enumerate(trees.values()):
        for i, ((_, _, leaf), r) in enumerate(own):
            steps = [*way(levels, i), *way(top, k)]
            folded = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                folded = brute_leaf([*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])])
            for left, right in steps:
                folded = sha(*left, folded, *right)
            out.append((r[0], leaf, levels[-1][0], top[-1][0], sha(*[x for a, b in steps for x in a + b]), folded, folded == top[-1][0]))
    return out


def as_text(rows):
    return sorted(map(repr, rows))


def proved(m, leaves=None):
    found = merkle.proofs(m, leaves, claimed="tampered", keep=("order",))
    return [tuple(r) for r in found.select("order", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def test_merkle_query_is_brute_force(spark, sf_dir):
    got = llm.queries()["op11_merkle"](spark, sf_dir)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.FIELDS).collect()]
    assert as_text(map(tuple, got.collect())) == as_text(brute_proofs(rows))


def test_merkle_of_many_trees_nulls_and_repeats(spark):
    """Trees of one leaf to more than a block, 70 of them, null and repeated ids, null and equal rows."""
    random.seed(7)
    langs = [None, "", "é", "zz", *map(str, range(66))]
    rows = [(random.choice([None, *range(4_000)]), random.choice(["a", None]), "en" if i % 3 else random.choice(langs), random.choice([None, 5]), random.choice([None, "", "Abc", "abc É"])) for i in range(7_500)]
    m = merkle.manifest(merkle.document_leaves(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")))
    want = brute_proofs(rows)
    assert as_text(proved(m)) == as_text(want)
    assert m.root() == want[0][3]
    some = m.leaves.filter("order in (5, 77, 1000) or tree = '=zz'")
    few = merkle.proofs(m, some, keep=("order", "tree"), with_siblings=True).collect()
    assert len(few) == some.count() > 3
    known = {(r[0], r[1]): r[4] for r in want}
    assert all(r.verified and r.proof_sha256 == known[r.order, r.leaf] == sha(*r.siblings) for r in few)


def test_missing_nodes_are_the_fewest():
    """Every run that a wanted node lies in is completed, nothing that can be derived is fetched."""
    assert [(level, list(p)) for level, p in merkle.missing(np.arange(8), 8)] == [(0, [])]
    assert [(level, list(p)) for level, p in merkle.missing(np.array([0, 9]), 20)] == [(0, [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15]), (1, [2])]
    assert list(merkle.missing(np.array([0]), 1)) == []
    random.seed(3)
    for _ in range(50):
        total = random.randint(1, 700)
        wanted = sorted(random.sample(range(total), random.randint(1, min(total, 20))))
        leaves = [sha(str(i)) for i in range(total)]
        levels = brute_tree(leaves)
        fetched = {(level, int(p)): levels[level][p].encode() for level, found in merkle.missing(np.array(wanted), total) for p in found}
        proof = merkle.Multiproof({i: leaves[i].encode() for i in wanted}, total, fetched)
        assert proof.root.decode() == levels[-1][0]
        for i in wanted:
            assert proof.siblings(i).decode() == "".join(x for a, b in way(levels, i) for x in a + b)
            assert proof.fold(leaves[i].encode(), i) == proof.root
            assert total == 1 or proof.fold(sha("else").encode(), i) != proof.root


def test_merkle_on_awkward_tables(spark, awkward, nothing):
    rows = [tuple(r) for r in awkward.select(*merkle.FIELDS).collect()]
    m = merkle.manifest(merkle.document_leaves(awkward))
    assert as_text(proved(m)) == as_text(brute_proofs(rows))
    empty = merkle.manifest(merkle.document_leaves(nothing))
    assert empty.root() is None
    assert proved(empty) == []


# -- op12


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.PieceModel(sentence_pieces.default_model())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())


def same_pieces(pieces, library, texts):
    ids = [np.frombuffer(x, "<i4") for x in pieces.encode(texts)]
    want = [library.encode(t) for t in texts]
    assert [x.tolist() for x in ids] == want
    assert [t.decode() for t in pieces.decode(ids)] == [library.decode(w) for w in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="ab c▁\n\t1=-<>0xé", max_size=80) | st.text(alphabet="aeinorst ", max_size=80), max_size=6))
def test_pieces_of_any_texts(pieces, library, texts):
    same_pieces(pieces, library, texts)


def test_pieces_of_joined_pieces_and_runs(pieces, library):
    random.seed(11)
    words = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    same_pieces(pieces, library, ["".join(random.choices(words, k=30)) for _ in range(1_500)])
    same_pieces(pieces, library, [" " * a + mid + " " * b for mid in ("", "a", "the", "ζ", "1") for a in range(0, 36, 3) for b in range(0, 36, 5)])
    same_pieces(pieces, library, [c * n for c in ("x", "=", "ab", "aa ", "-_", "é") for n in (1, 2, 3, 31, 1_000)])
    same_pieces(pieces, library, ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)), "".join(random.choices("那是一个 日本語", k=5_000))])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, 31_999), max_size=12))
def test_decoding_of_any_ids(pieces, library, ids):
    assert pieces.decode([np.array(ids, np.int64)])[0].decode() == library.decode(ids)


def piece_rows(library, rows):
    out = []
    for own, text in rows:
        ids = library.encode(text or "", add_eos=True)
        out.append((own, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return out


def test_piece_query_is_the_library(spark, sf_dir, library):
    got = llm.queries()["op12_sentence_pieces"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert as_text(map(tuple, got.collect())) == as_text(piece_rows(library, rows))


def test_pieces_on_awkward_tables(spark, awkward, nothing, library):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert as_text(map(tuple, sentence_pieces.round_trip(awkward).collect())) == as_text(piece_rows(library, rows))
    ids = sentence_pieces.encoded(awkward)
    assert as_text(map(tuple, sentence_pieces.decoded(ids).collect())) == as_text([(own, text or "") for own, text in rows])
    assert sentence_pieces.round_trip(nothing).count() == sentence_pieces.decoded(sentence_pieces.encoded(nothing)).count() == 0


def test_words_of_an_older_generation_stay_right(pieces, library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "KEPT", 5)
    for turn in range(4):
        same_pieces(pieces, library, [f"some words {turn} come again and again", f"others only once: w{turn}x"])


# -- op13


def brute_counts(rows):
    counts = {}
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if own is None else own}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_apart(counts):
    near = {w: set() for w in counts}
    letters = {c for w in counts for c in w}
    for w in counts:
        for i in range(len(w)):
            found = {w[:i] + w[i + 1 :]} | {w[:i] + c + w[i + 1 :] for c in letters}
            for x in found & counts.keys() - {w}:
                near[w].add(x)
                near[x].add(w)
    return near


def brute_variants(counts, times=10):
    near = one_apart(counts)
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= times * n:
                form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def test_spelling_query_is_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = llm.queries()["op13_spelling"](spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_variants(brute_counts(rows))
    assert any(r[1] for r in want)
    assert as_text(map(tuple, got.collect())) == as_text(want)


@pytest.mark.parametrize(("letters", "least", "most"), [("ab", 7, 12), ("abé", 7, 9), ("abcdeÀÿ", 7, 8), ("abc", 9, 15)])
def test_all_near_words_are_found(spark, letters, least, most):
    """Dense words, so that gram lists are long, grams of all lengths open and lists split."""
    random.seed(len(letters) + most)
    counts = {"".join(random.choices(letters, k=random.randint(least, most))): random.randint(2, 900) for _ in range(1_500)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = {(a, b) for a, own in one_apart(counts).items() for b in own}
    for grams in ((2, 4), (2, 6), (3, 5)):
        got = [(r.word, r.other) for r in spelling.near_words(words, *grams, rare=4, share=20).collect()]
        assert len(set(got)) == len(got)
        assert {x for a, b in got for x in ((a, b), (b, a))} == want


def test_affected_grams_bound_what_an_edit_changes(spark):
    """Any one edit leaves at least the grams that the bound promises, at their place or one beside it."""
    random.seed(2)
    words = ["".join(random.choices("abc", k=random.randint(7, 13))) for _ in range(400)]
    dictionary = spelling.gram_dictionary(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), 2, 5, 1_000, 5)

    def grams(word):
        own, code, _, length, affected = dictionary.decompose(spelling.letters_of([word]))
        return {(int(code[0, p]), int(length[0, p]), int(p)) for p in np.flatnonzero(own[0])}, int(affected[0])

    for word in words[:150]:
        mine, affected = grams(word)
        for i in range(len(word) + 1):
            for other, step in ((word[:i] + word[i + 1 :], -1), (word[:i] + "b" + word[i:], 1), (word[:i] + "c" + word[i + 1 :], 0)):
                theirs, _ = grams(other)
                if len(other) >= 7:
                    assert sum(g in theirs or (g[0], g[1], g[2] + step) in theirs for g in mine) >= len(mine) - affected


def test_forms_lead_to_roots_over_several_steps(spark):
    """A chain of 13 forms, ties in count, and a word below ten times."""
    chain = ["a" * k + "b" * (14 - k) for k in range(14)]
    counts = {w: 10**k for k, w in enumerate(chain)} | {"zzzzzzz": 3, "zzzzzzx": 40, "zzzzzzy": 40, "qqqqqqq": 5, "qqqqqqw": 49}
    words = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long")
    got = [tuple(r) for r in spelling.variants(words).collect()]
    assert as_text(got) == as_text(brute_variants(counts))
    roots = {r[0]: r[2] for r in got}
    assert roots[chain[0]] == chain[-1]
    assert roots["zzzzzzz"] == "zzzzzzx"
    assert roots["qqqqqqq"] == "qqqqqqq"


def test_spelling_on_awkward_tables(spark, awkward, nothing):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert as_text(map(tuple, spelling.spelling_variants(awkward).collect())) == as_text(brute_variants(brute_counts(rows)))
    assert spelling.spelling_variants(nothing).count() == 0
    long = docs_of(spark, ["spelling " * 30_000 + "Spellings ÀSPELLING spellingx", None, "speling speling spelliñg spelliñg"])
    rows = [tuple(r) for r in long.select("doc_id", "text").collect()]
    assert as_text(map(tuple, spelling.spelling_variants(long).collect())) == as_text(brute_variants(brute_counts(rows)))


# -- op2


def test_a_rollup_is_one_state_for_all_handles_and_restarts(spark, monkeypatch):
    """A new handle on the known path goes on from a compaction; one that dies before the switch leaves the old state in use."""
    changes = spark.createDataFrame([("s", "en", "v", 1, 3)], token_counts.SCHEMA.replace(", folded string, batch string", ""))
    path = token_counts.state_folder(spark, "restart")
    one, two = token_counts.Rollup(spark, path), token_counts.Rollup(spark, path)

    def state(roll):
        return [(r.docs, r.tokens) for r in roll.totals().collect()]

    one.commit("a", changes)
    one.commit("b", changes)
    with monkeypatch.context() as m:
        m.setattr(type(one.pointer), "set", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            one.compact("base")
    assert state(one) == state(two) == state(token_counts.Rollup(spark, path)) == [(2, 6)]
    one.compact("base")
    assert two.commit("a", changes) is False
    assert token_counts.Rollup(spark, path).commit("c", changes) is True
    two.compact("base2")
    assert one.commit("c", changes) is False
    assert state(one) == state(two) == state(token_counts.Rollup(spark, path)) == [(3, 9)]


# -- op10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([chr(c) for c in range(0x21, 0x7F)] + list("ÀÉÖØßàéöøÿ×÷ªµº日İ́") + ["<|endoftext|>", "'s", "12", "mail9.example.com"]), max_size=12).map("".join))
def test_words_are_cut_as_the_tokenizer_does(encoder, word):
    assert np.frombuffer(encoder.word(word), "<u4").tolist() == encoder.tokenizer.encode(word, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(packing.default_tokenizer())
