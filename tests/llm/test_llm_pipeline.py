"""The pipeline's stages on planted rows against plain Python at the production parameters."""

import collections
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from lodestone.llm import scratch, tokens

SF = "/root/testdata/sf0.001"
NAMES = [n for n, _ in corpus_pipeline.STAGES]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name, spark, rows, sf=SF):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted(dict(corpus_pipeline.STAGES)[name](spark, docs, sf).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def prose(k, words=80, lead="w"):
    own = "".join(chr(97 + int(c)) for c in str(k))  # letters, for lines are compared with digits read as 0
    return " ".join(f"{lead}{own}x{i}" for i in range(words))


def test_stages_agree_with_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    for _, one in corpus_pipeline.STAGES[:-1]:
        docs = scratch.saved(one(spark, docs, SF), "stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[-1] > n[0] // 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    one, two = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)  # neither disturbs the other
    assert one.select("doc_id").distinct().count() == two.select("doc_id").distinct().count() == last.select("doc_id").distinct().count() == n[-1]


def test_quality_stage(spark):
    rows = [(i, prose(i) + "\nShared line 7 of words" * (i < 30), "en", "a", 0) for i in range(60)]
    rows += [(100, prose(100, 49), "en", "a", 0), (101, " ".join(["x y z"] * 40), "en", "a", 0), (102, None, "en", None, 0), (103, "", "", "", 0)]
    rows += [(200 + i, prose(200 + i, 15) + "\n" + " ".join(f"cookie{j}" for j in range(60)), "en", "b", 0) for i in range(25)]
    want = {}
    for host in {r[3] for r in rows}:
        own = [r for r in rows if r[3] == host]
        norm = lambda x: re.sub(" +", " ", re.sub("[0-9]", "0", x.strip().lower()))
        seen = collections.defaultdict(set)
        for r in own:
            for line in (r[1] or "").split("\n"):
                if line.strip():
                    seen[norm(line)].add(r[1])
        over = {x for x, t in seen.items() if len(t) > 20 and 100 * len(t) > 2 * len({r[1] or "" for r in own}) or len(t) > 1000}
        for r in own:
            words = (r[1] or "").split()
            grams = list(zip(words, words[1:], words[2:], strict=False))
            counts = collections.Counter(grams)
            repeated = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
            kept = [x for x in (r[1] or "").split("\n") if not x.strip() or norm(x) not in over]
            if len(words) >= 50 and 2 * len(repeated) <= len(words) and 100 * len(" ".join(kept).split()) >= 30 * len(words):
                want[r[0]] = "\n".join(kept)
    got = stage("quality_rules", spark, rows)
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert set(range(60)) <= set(want) and "Shared" not in want[3] and not {100, 101, 102, 103, 200} & set(want)


def test_near_duplicate_stage(spark):
    base = [prose(k, 120) for k in range(6)]
    edited = lambda t, places: " ".join("changed" if i in places else w for i, w in enumerate(t.split()))
    rows = [(10 * k + j, t, "", "a", 0) for k, b in enumerate(base) for j, t in enumerate((b, b, edited(b, {50}), edited(b, {20, 90}), edited(b, {10, 30, 50, 70, 90, 110})))]
    rows += [(500, base[5].upper(), "", "a", 0), (501, None, "", "", 0), (502, None, "", "", 0), (503, "short one", "", "", 0), (503, "short one", "", "", 0), (None, "no name here", "", "", 0)]
    sets = {}
    for r in rows:
        w = (r[1] or "").lower().split()
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets if d is not None}
    def find(v):
        return v if root[v] == v else find(root[v])
    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {d: dict((r[0], r[1]) for r in rows)[d] for d in ids if find(d) == d} | {None: "no name here"}
    got = stage("near_duplicates", spark, rows)
    assert len(got) == len(want) and {r.doc_id: r.text for r in got} == want and 4 in want and 1 not in want


def test_decontamination_stage(spark, tmp_path):
    items = [(1, prose(1, 12, "q")), (2, prose(2, 9, "q")), (3, "Only three words"), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"before {items[0][1]} after", "", "", 0), (2, f"{items[0][1]} and {items[1][1]}", "", "", 0), (3, "nothing", "", "", 0), (4, "see ONLY, three words!", "", "", 0), (5, None, "", "", 0), (6, " ".join(items[0][1].split()[:7]), "", "", 0)]
    want = {1: "before  after", 3: "nothing", 4: "see !", 5: None, 6: rows[5][1]}
    assert {r.doc_id: r.text for r in stage("decontamination", spark, rows, str(tmp_path))} == want


def test_personal_data_stage(spark):
    rows = [(1, "write to Ann.Lee@mail.org or a.b@x.org", "en", "a", 1), (2, "nothing to hide", "en", "a", 1), (3, "again ann.lee@mail.org", "en", "a", 1), (4, None, "", "", 0), (None, "10.0.0.1", "", "", 0)]
    got = {r.doc_id: r for r in stage("pii_surrogates", spark, rows)}
    m = re.fullmatch(r"write to ([A-Z][a-z]{2}\.[A-Z][a-z]{2}@[a-z]{4}\.org) or [a-z]\.[a-z]@[a-z]\.org", got[1].text)
    assert m and "ann.lee" not in m[1].lower() and got[3].text == f"again {m[1].lower()}" and got[2].text == "nothing to hide" and got[4].text is None
    assert re.fullmatch(r"[\d.]{7,15}", got[None].text) and got[None].text != "10.0.0.1" and got[1].n_chars == len(got[1].text)


def test_packing_stage(spark):
    rows = [(i, prose(i, 30 + 40 * (i % 7)) if i % 9 else None, "en", "ab"[i % 3 == 0], 0) for i in range(60)]
    got = stage("packing", spark, rows)
    store, whole, places = tokens.Words(public_tokenizers.path("byte_bpe_50k.json")), collections.defaultdict(dict), collections.defaultdict(list)
    for r in got:
        whole[r.doc_id][r.start] = r.ids
        places[r.sequence_id].append((r.offset, r.length))
    for d, t, *_ in rows:
        flat = np.frombuffer(b"".join(whole[d][k] for k in sorted(whole[d])), "<u4").tolist()
        assert flat == [*store.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    for own in places.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0
    assert all(sum(n for _, n in own) == 2048 for k, own in places.items() if k < max(places))


@pytest.mark.parametrize("name", NAMES)
def test_stages_of_empty_and_widened_tables(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0
    more = spark.createDataFrame([(1, prose(1), "en", "a", 0)], SCHEMA).selectExpr("*", *(f"'mine' as {c}" for c in ("row", "kept", "items", "entities", "n_words", "node", "ids")))
    got = dict(corpus_pipeline.STAGES)[name](spark, more, SF)
    assert got.select("doc_id").distinct().count() == 1 and (name == "packing" or got.columns == corpus_pipeline.COLUMNS)
