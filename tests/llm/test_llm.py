"""The llm operators against brute force on small inputs and the small tables."""

import random
import unicodedata
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import components, leakage, mixing, queries, sentences, setjoin, terms
from loomgraph.operators import skew
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert compare(spark, SF, name) == ""


def pages(spark, rows):
    return spark.createDataFrame(rows, "slug string, ord bigint, tags array<string>, type string, sources array<string>, note string")


# terms


def test_terms_handle_nulls_repeats_and_hot_terms(spark):
    rows = [("p1", 1, ["A", None, " ", "a", "b"], "T", [], "x"), ("p1", 1, ["A", None, " ", "a", "b"], "T", [], "x"), ("p2", 2, None, None, None, None), ("p3", None, ["[[a]]"], "", None, None)]
    rows += [(f"h{i}", 100 + i, ["hot"] * 3, "t", None, None) for i in range(500)]
    got = {(r.field, r.term): (r.n, r.n_records) for r in terms.term_frequencies(terms.page_terms(pages(spark, rows))).collect()}
    assert got == {("tags", "a"): (3, 2), ("tags", "b"): (1, 1), ("tags", "hot"): (1500, 500), ("type", "t"): (501, 501)}
    marks = {r.term: r.mark for r in terms.marked(spark.createDataFrame([("f", "x", 1, 2), ("f", "y", 1, 11), ("f", "z", 1, 10)], "field string, term string, n bigint, n_records bigint"), 100).collect()}
    assert marks == {"x": "rare", "y": "common", "z": None}
    terms.COMMON_SHARE, old = 0.15, terms.COMMON_SHARE
    try:
        rows = spark.createDataFrame([("f", str(n), 1, n) for n in (14, 15, 16)], "field string, term string, n bigint, n_records bigint")
        assert [r.mark for r in terms.marked(rows, 100).orderBy("term").collect()] == [None, None, "common"]
    finally:
        terms.COMMON_SHARE = old


def test_terms_count_a_record_once_over_many_partitions(spark):
    rows = [(f"p{i % 10}", i, ["a"] * 20, None, None, None) for i in range(100)]
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "48"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = [tuple(r) for r in terms.term_frequencies(terms.page_terms(pages(spark, rows))).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [("tags", "a", 2000, 10)]


def test_terms_of_nothing(spark):
    assert terms.term_frequencies(terms.page_terms(pages(spark, []))).count() == 0


# components


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"v{rng.randrange(150):03}", f"v{rng.randrange(150):03}") for _ in range(90)]
    pairs += [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("hub", f"h{i}") for i in range(300)] + [("loop", "loop")]
    got = components.hash_to_min(spark.createDataFrame(pairs * 2, "a string, b string"))
    assert {tuple(r) for r in got.collect()} == union_find(pairs)


def test_links_drop_blank_ends(spark):
    rows = spark.createDataFrame([("A ", "[[b]]"), (None, "x"), ("", "y"), ("z", " "), ("a", "B"), ("q", "q")], "source string, target string")
    assert sorted(map(tuple, components.links(rows).collect())) == [("a", "b"), ("q", "q")]
    assert components.hash_to_min(components.links(rows.where("false"))).count() == 0


# set join


@pytest.mark.parametrize("seed", [3, 4])
def test_similar_pairs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    sets = {f"p{i:03}": frozenset(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9), weights=range(1, 17))) for i in range(160)}
    sets |= {f"q{i}": frozenset("abc") for i in range(12)}
    tokens = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "id string, token string")
    ids = spark.createDataFrame([(k,) for k in sets], "id string")
    grouped, membership = setjoin.classes(ids, tokens)
    pairs = setjoin.similar_classes(grouped)
    got = [tuple(r) for r in setjoin.expand(pairs, membership).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and set(got) == want
    links = {r.id: r.n_links for r in setjoin.links_per_id(pairs, grouped, membership).collect()}
    assert links == {k: sum(k in p for p in want) for k in sets}


def test_similar_pairs_of_large_sets(spark):
    """Sets of a thousand tokens: a probe row per prefix token and band of sizes, not per size, and none of them holds a set."""
    sets = {f"s{i}": {f"t{j}" for j in range(i * 40, i * 40 + 1000 - i)} for i in range(12)} | {"copy": {f"t{j}" for j in range(1000)}, "one": {"t1"}}
    tokens = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "id string, token string")
    grouped, membership = setjoin.classes(spark.createDataFrame([(k,) for k in sets], "id string"), tokens)
    pairs = setjoin.similar_classes(grouped)
    got = {tuple(r) for r in setjoin.expand(pairs, membership).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}
    assert ("copy", "s0") in got and len(got) > 50


@pytest.mark.parametrize("least_heavy", [5, 1000])
def test_pairs_of_a_class_of_copies(spark, monkeypatch, least_heavy):
    """Copies that are a third of all ids, with the class spread over all tasks or not."""
    monkeypatch.setattr(skew, "LEAST_HEAVY", least_heavy)
    sets = {f"c{i:02}": {"a", "b", "c"} for i in range(40)} | {f"d{i:02}": {"a", "b", "c", "d"} for i in range(20)} | {f"e{i:02}": {f"x{i}", "y"} for i in range(20)}
    tokens = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "id string, token string")
    grouped, membership = setjoin.classes(spark.createDataFrame([(k,) for k in sets], "id string"), tokens)
    got = [tuple(r) for r in setjoin.expand(setjoin.similar_classes(grouped), membership).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("threshold", [Fraction(1, 3), Fraction(4, 5), Fraction(1)])
def test_similar_pairs_at_other_thresholds(spark, threshold):
    rng = random.Random(7)
    sets = {f"p{i:03}": frozenset(rng.choices("abcdefgh", k=rng.randint(1, 7))) for i in range(60)}
    tokens = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "id string, token string")
    grouped, membership = setjoin.classes(spark.createDataFrame([(k,) for k in sets], "id string"), tokens)
    got = {tuple(r) for r in setjoin.expand(setjoin.similar_classes(grouped, threshold), membership).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_similar_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, token string")
    grouped, membership = setjoin.classes(empty.select("id"), empty)
    assert setjoin.expand(setjoin.similar_classes(grouped), membership).count() == 0


# leakage


def brute_leaks(docs, items, run=leakage.RUN):
    wanted = {}
    for item, text in items:
        w = leakage.words(text)
        for i in range(max(1, len(w) - run + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + run]), set()).add(item)
    out = set()
    for doc, body in docs:
        w = leakage.words(body)
        for n in {len(r) for r in wanted}:
            for i in range(len(w) - n + 1):
                out |= {(doc, item) for item in wanted.get(tuple(w[i : i + n]), ())}
    return out


def test_leaks_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/eval_items.parquet").select("item_id", "text").collect()]
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "x " * 50_000 + (items[0][1]))]
    items += [(10**6, None), (10**6 + 1, "!!"), (10**6 + 2, "x x")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in leakage.leaks(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items) and (10**6 + 2, items[0][0]) in got
    assert leakage.leaks(d, i.where("false")).count() == 0 == leakage.leaks(d.where("false"), i).count()


def test_every_run_holds_one_block():
    for run in (1, 2, 5, 12, 13):
        for length in range(60):
            size, starts = leakage.blocks(length, run)
            for i in range(max(0, length - run + 1) if length > run else 0):
                assert sum(i <= s and s + size <= i + run for s in starts) == 1
            assert length > run or (size, starts) == (length, [0] * (length > 0))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_machine_equals_brute_force(seed):
    """Few words, so that items overlap one another and themselves; a repeated id; one pattern over all items."""
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choices("ab", k=n))
    items = [(i % 30, line(rng.choice([1, 3, 11, 12, 13, 40]))) for i in range(40)]
    docs = [(i, line(rng.randint(0, 80))) for i in range(60)] + [(99, "zz " + items[0][1] + " zz " + items[1][1])]
    for run in (12, 7, 4):
        machine = leakage.Machine(items, run)
        got = {(d, i): spans for d, text in docs for i, spans in machine.scan(leakage.words(text)).items()}
        assert set(got) == brute_leaks(docs, items, run)


def test_passage_offsets_map_back(spark):
    body = "Ｘ ﬁ " + "Ｏｎｅ **two**, [[three]] ４ five six seven eight nine ten eleven twelve" + " the end é"
    item = "one two three 4 five six seven eight nine ten eleven twelve"
    machine = leakage.Machine([(7, item)])
    ((i, s, e, n),) = leakage.passages(body, machine.scan(leakage.words(body)))
    assert (i, n) == (7, 12) and body[s:e].startswith("Ｏｎｅ") and body[s:e].endswith("twelve")
    assert leakage.words("a_b ②の漢") == ["a", "b", "2", "の", "漢"]
    for text in ("ﬁx 한국 é́ ｶﾞ", "plain", "ΑΣ ΟΔΟΣ"):
        assert len(leakage.origin(text)) == len(unicodedata.normalize("NFKC", text).lower())


# mixing


def test_trade_keeps_mass_and_expectation():
    rng = random.Random(0)
    for _ in range(500):
        p, q, a, b = rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99), rng.randint(1, 50), rng.randint(1, 50)
        x, y = mixing.trade(p, a, q, b, rng.random())
        assert abs(a * x + b * y - a * p - b * q) < 1e-6 and (x in (0, 1) or y in (0, 1)) and 0 <= x <= 1 and 0 <= y <= 1
    mean = sum(mixing.trade(0.3, 5, 0.6, 2, rng.random())[0] for _ in range(20_000)) / 20_000
    assert abs(mean - 0.3) < 0.01


def test_plan_water_fills():
    sizes = {"a": 100, "b": 10}
    total, copies = mixing.plan(sizes, {"a": (0.5, 1), "b": (0.4, 2), "c": (0.1, 1)})
    assert copies["b"] == 2 and abs(copies["a"] * 100 - 25) < 1e-9 and abs(total - 45) < 1e-9
    assert mixing.plan(sizes, {"a": (0.5, 1), "b": (0.5, 2)}, total=100)[1] == {"b": 2.0, "a": 0.8}
    assert mixing.plan({}, {"a": (1.0, 1)}) == (0.0, {})


@pytest.mark.parametrize("per_bucket", [7, 20_000])
def test_mix_meets_shares(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", per_bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(5)
    rows = [(i, rng.choice("aaab"), rng.randint(0, 40)) for i in range(900)] + [(900, None, 5), (901, "z", 5), (902, "a", 3000)]
    counted = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([(" A", 0.5, 1), ("b", 0.3, 3), ("gone", 0.2, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(counted, targets).cache()
    got = {r.source: r for r in mixing.shares(mixed, counted, targets).collect()}
    assert set(got) == {"a", "b", "gone"} and got["gone"].tokens_mixed == 0
    assert abs(got["a"].actual_share - 0.625) < 0.01 and abs(got["b"].actual_share - 0.375) < 0.01
    assert got["a"].most_copies <= 1 and got["b"].most_copies <= 3
    assert mixed.count() == mixed.select("doc_id").distinct().count()
    assert sorted(mixed.collect()) == sorted(mixing.mix(counted, targets).collect())


def test_mix_of_nothing(spark):
    counted = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(counted, targets)
    assert mixed.count() == 0 and [r.tokens_mixed for r in mixing.shares(mixed, counted, targets).collect()] == [0]


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "hello world", "A "), (2, None, None), (3, "", "b/")], "doc_id bigint, text string, source string")
    assert sorted(map(tuple, mixing.token_counts(docs).collect())) == [(1, "a", 2), (2, None, 0), (3, "b", 0)]


# sentences

CASES = {
    "en": ['Dr. A. Lee paid 3.5 bn, e.g. in the U.S. market.[3]', 'He asked: "Is it? By whom?"', "“All of it. Now.”", "(See also No. 4.)", "No.", "The call closed at 5 p.m.", "It rose... or so we hoped... to v1.2.3!"],
    "de": ["Am 3. März meldete Dr. Li, z. B. in Abb. 4, ca. 5 Fälle.", "„Es fällt. Das war klar“, schrieb sie.", "Das war am 1. Mai.", "Kupfer, Zinn usw."],
    "fr": ["Selon M. Roy, cf. p. 3 du rapport, c’est vrai !", "« Il baissera. Patience », écrit-il.", "Pourquoi ?"],
    "es": ["La Dra. Paz vive en EE. UU. desde las 4:30 h.", "¿Por qué?", "«Caerá. Paciencia», dijo."],
    "zh": ["“会回落。再等等。”李明在纪要里写道。", "《月报》提到铜（见图1。）但没有来源？！", "版本v1.2之前没有……", "“完整的一句。”", "铜呢？"],
    "ja": ["「下がる。待とう。」とDr. Leeは書いた。", "なぜか？", "約3件がある…。"],
    "hi": ["डॉ. ओर ने पृ. 3 देखा।", "“घटेगी। रुकिए।” Quorin Labs ने लिखा॥", "क्यों?"],
}


@pytest.mark.parametrize("lang", sorted(CASES))
@pytest.mark.parametrize("label", ["own", None, "und"])
def test_sentences_are_found_again(lang, label):
    parts = CASES[lang]
    text = ("" if lang in ("zh", "ja") else " ").join(parts)
    got = [text[s:e] for s, e in sentences.sentences(text, lang if label == "own" else label)]
    assert got == parts


def test_sentences_see_as_far_as_needed():
    """No distance changes a decision: blanks before a small letter, long tags of speech, long words before a mark, notes inside a quotation."""
    for n in (1, 10, 120, 5000):
        assert len(sentences.sentences("He sold zinc, tin etc." + " " * n + "and left.")) == 1
        assert len(sentences.sentences("He came at last." + " " * n + "and left.")) == 2
        assert len(sentences.sentences("He came at last." + " " * n + "He left.")) == 2
        tag = "李明" * n
        assert len(sentences.sentences(f"“会回落。再等等。”{tag}写道。铜呢？", "zh")) == 2
        assert len(sentences.sentences(f"“घटेगी। रुकिए।” {'लंबा ' * n}Labs ने लिखा। क्यों?", "hi")) == 2
        assert len(sentences.sentences("क" * n + ". और भी।", "hi")) == 1
        assert len(sentences.sentences(f"“It fell. {'x' * n} waited.[12]” He left.")) == 2
    for lang in ("en", "de", None):
        assert len(sentences.sentences("See a.b.c v1.2 and e.g.this.", lang)) == 1


def test_sentences_that_begin_small_or_without_a_blank():
    for parts in (
        ["It was shared by both shelves.", "explain why it was."], ["AFTER PORT CONGESTION.", "answer: the shelf."], ["Are they relinked at 3.7 each?", "the register shows it."], ["(It never caught up.)", "so they say."],
        ["The call closed at 5 p.m.", "bujabuno台帳の502枚。"], ["“It will keep the old links.”", "rafijeti台帳の287枚。"], ["Links, foil, etc. were merged by Oak Corp. and its peers at 9 a.m. on Monday."], ["Foil... or so they hoped... never came."],
    ):
        text = " ".join(parts)
        assert [text[s:e] for s, e in sentences.sentences(text, "en")] == parts
    for parts in (["The note admits.", '"It will fall. Wait," he said.'], ["指数持平……", "(Run it twice.)"], ["基本持平……", "„Es fällt. Ja.“"]):
        text = "".join(parts)
        assert [text[s:e] for s, e in sentences.sentences(text)] == parts


def test_sentences_blocks_and_thai():
    text = "# A. B? C\n\n- one. Two\n* three\nhard\nwrapped text.Next one\n\nราคาเพิ่มขึ้น 9.7 เปอร์เซ็นต์ ยังไม่มี! เพราะ\n"
    assert [text[s:e] for s, e in sentences.sentences(text)] == ["# A. B? C", "- one. Two", "* three", "hard\nwrapped text.", "Next one", "ราคาเพิ่มขึ้น 9.7 เปอร์เซ็นต์", "ยังไม่มี!", "เพราะ"]
    assert sentences.sentences(None) == sentences.sentences("") == sentences.sentences(" \n") == []


def test_sentences_cover_every_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "“" * 3000 + "a. B" * 3000, "en"), (-4, "...", None)], docs.schema)
    rows = sentences.sentence_rows(docs.unionByName(odd)).orderBy("doc_id", "start_char").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias("s"))
    spans = {r.doc_id: [tuple(x) for x in r.s] for r in rows.collect()}
    for r in docs.unionByName(odd).collect():
        at, text = 0, r.text or ""
        for s, e in spans.get(r.doc_id, []):
            assert at <= s < e and not text[at:s].strip() and text[s:e] == text[s:e].strip()
            at = e
        assert not text[at:].strip()
