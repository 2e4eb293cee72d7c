import collections
import random
import re

from foliant.llm import decontaminate as D

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "lo", "mi")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_passages_are_caught_and_clean_documents_are_not(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randrange(16, 40)).capitalize() + ".") for i in range(20)]
    items += [(100, "Maria Lopez buys 12 apples for 3 dollars and sells 12 pears to her brother Juan in Madrid on 4 days."), (101, "short one here")]
    docs, want = [], set()
    for i in range(60):
        text = prose(rng, 50)
        if i % 3 == 0:
            text += "\n" + items[i // 3][1] + " " + prose(rng, 30)
            want.add((i, i // 3))
        docs.append((i, text))
    said = "so Anna Schmidt buys 75 apples for 9 dollars and sells 75 pears to her brother Peter in Berlin on 2 days."
    docs += [(200, said), (201, said.replace("75 apples", "9 apples")[:60]), (206, "x and then Maria Lopez buys 12 apples for 3 dollars and sells 12 pears to her"), (202, "a short one here indeed"), (203, None), (204, ""), (None, items[0][1]), (205, items[1][1].upper())]
    bench = spark.createDataFrame([*items, (102, None), (103, "")], "item_id long, text string")
    df = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, item_id string")
    found = D.find(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want | {(200, 100), (206, 100), (202, 101), (None, 0), (205, 1)}
    assert {r.doc_id: r.n_reworded > 0 for r in found}[200]
    left = {r.doc_id for r in D.clean(df, bench).collect()}
    assert left == {d for d, _ in docs} - {r.doc_id for r in found}
    assert D.find(df.limit(0), bench).collect() == [] and D.find(df, bench.limit(0)).collect() == []


def test_names_that_open_sentences_numbers_and_case(spark):
    said = "Alice has 3 apples. Bob has 5 pears. Alice gives 2 apples to Bob and asks how many he has now."
    short, price = "Maria walks 4 miles to school every single day.", "A shop in Berlin sells 3 red lamps and 1,200 blue chairs for 95 euros every second week of May."
    verbatim = "the mayor of Madrid met Juan Lopez near the old Toledo bridge while Pedro Ñunez sold maps"
    bench = spark.createDataFrame([(0, said), (1, short), (2, price), (3, verbatim)], "item_id long, text string")
    docs = [
        (10, "Carol has 4 apples. Dan has 7 pears. Carol gives 1 apples to Dan and asks how many he has now.", 0),
        (11, "Carol has 4 apples. Dan has 7 pears. Dan gives 1 apples to Dan and asks how many Carol has now.", None),
        (12, "So said:\nCarol has 4 apples.\nDan has 7 pears. Carol gives 1\napples to Dan and asks how many he has now.", 0),
        (13, "Now then. Julia walks 9 miles to school every single day. End.", 1),
        (14, "A shop in Paris sells 3.5 red lamps and 14 blue chairs for 9,000.25 euros every second week of May.", 2),
        (15, verbatim.upper(), 3),
        (16, verbatim.lower(), 3),
        (17, verbatim.replace(" ", "\n").title(), 3),
        (18, "Carol had 4 apples. Dan had 7 pears. Carol gave 1 apple to Dan and asked how much he had then.", None),
    ]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find(df, bench).collect()} == {(d, i) for d, _, i in docs if i is not None}


def words_of(text):
    out, word = [], ""
    for c in text + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in word))
            word = ""
        else:
            word += c
    return out


def test_driver_tables_by_brute_force(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    windows = {}
    for r in bench.collect():
        w = words_of(r.text)
        for i in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(r.item_id)
    want = set()
    for r in docs.collect():
        w = words_of(r.text)
        want |= {(r.doc_id, item) for n in {len(k) for k in windows} for i in range(len(w) - n + 1) for item in windows.get(tuple(w[i : i + n]), ())}
    assert want <= {(r.doc_id, r.item_id) for r in D.find(docs, bench).collect()}
    assert len({r.doc_id for r in D.find(docs, bench).collect()} - {d for d, _ in want}) == 0


def reference(docs, items, width=13):
    """Templates, windows, slots and matches by plain loops, for texts in which nothing opens a sentence."""

    def words(text):
        out = []
        for w in re.findall(r"[0-9A-Za-z]+", text):
            low = w.lower()
            kind = 1 if re.search("[0-9]", w) else 3 if low in D.UNITS else 2 if w[0].isupper() and len(w) > 1 and w[1].islower() else 0
            out.append((kind, low))
        return out

    def same_kind(a, b):
        return all((x[0], "" if x[0] else x[1]) == (y[0], "" if y[0] else y[1]) for x, y in zip(a, b, strict=True))

    def bijection(pairs):
        pairs = set(pairs)
        return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})

    out = {}
    for i, text in docs:
        mine = words(text)
        for j, item in items:
            theirs = words(item)
            k = min(width, len(theirs))
            matches = collections.defaultdict(list)
            for p in range(len(mine) - k + 1):
                for q in range(len(theirs) - k + 1):
                    a, b = mine[p : p + k], theirs[q : q + k]
                    if [w for _, w in a] == [w for _, w in b]:
                        matches[p - q].append((q, True, [] if not same_kind(a, b) else [(x, y) for x, y in zip(a, b, strict=True) if x[0]]))
                    elif same_kind(a, b):
                        pairs = [(x, y) for x, y in zip(a, b, strict=True) if x[0]]
                        if 2 * sum(not (x[0] == 2 and x == y) for x, y in pairs) <= k and bijection(pairs):
                            matches[p - q].append((q, False, pairs))
            counted = collections.defaultdict(bool)
            for some in matches.values():
                sound = bijection(x for _, _, pairs in some for x in pairs)
                for q, equal, _ in some:
                    if sound or equal:
                        counted[tuple((kind, "" if kind else w) for kind, w in theirs[q : q + k])] |= equal
            if counted:
                out[i, j] = (len(counted), sum(not e for e in counted.values()))
    return out


def test_templates_against_brute_force(spark):
    rng, vocabulary = random.Random(9), "the of and runs takes gives needs with from apples pears km kg Bob Alice Carol 3 12 7 99".split()
    item = lambda n: "so " + " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(rng.choice([5, 12, 20, 40]))) for i in range(12)]
    docs = []
    for i in range(120):
        text = items[rng.randrange(12)][1]
        names = dict(zip(["3", "12", "7", "99", "Bob", "Alice", "Carol"], rng.sample(["3", "12", "7", "99", "4", "50", "8"], 4) + rng.sample(["Bob", "Alice", "Carol", "Dave", "Eve"], 3), strict=True))
        if i % 3:
            text = " ".join(names.get(w, w) for w in text.split())
        if i % 4 == 3:  # one slot that does not follow
            w = text.split()
            slots = [k for k, x in enumerate(w) if x.isdigit()]
            if slots:
                w[rng.choice(slots)] = "1000"
            text = " ".join(w)
        docs.append((i, item(5) + " " + text + " " + item(3)))
    got = D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = reference(docs, items)
    assert {(r.doc_id, r.item_id): (r.n_windows, r.n_reworded) for r in got} == want
    assert any(0 < b < a for a, b in want.values()) and len(want) > 60


def test_slots_agree_over_the_whole_match(spark):
    item = "we pay 12 apples for the old horse that stood all day behind the red barn near our river and then we sell 12 pears to them again before the night"
    near, far = item.replace("12", "7"), item.replace("12", "7", 1).replace("12", "99")
    half = item.replace("12 pears", "99 pears")
    docs = spark.createDataFrame([(1, item), (2, near), (3, far), (4, half)], "doc_id long, text string")
    got = {r.doc_id: (r.n_windows, r.n_reworded) for r in D.find(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    n = len(item.split()) - 12
    assert got[1] == (n, 0) and got[2][0] == n and got[2][1] > 10
    assert got[3][1] == got[4][1] == 0 and got[3][0] < got[4][0] < n


def test_texts_that_share_an_id_or_have_none_are_matched_each(spark):
    item = "Anna buys 12 apples for 3 dollars and sells 7 pears to her brother Juan in Madrid after 4 days of rain."
    copies = [item.replace("12", "31").replace("Juan", "Pedro"), item.replace("12", "44").replace("Juan", "Luis").replace("Madrid", "Sevilla")]
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")

    def counts(ids):
        docs = spark.createDataFrame(list(zip(ids, copies, strict=True)), "doc_id long, text string")
        return {r.doc_id: (r.n_windows, r.n_reworded) for r in D.find(docs, bench).collect()}

    apart = counts([1, 2])
    assert set(apart) == {1, 2} and all(w > 0 for w, _ in apart.values())
    for shared in (7, None):
        together = counts([shared, shared])
        assert set(together) == {shared} and together[shared][0] >= max(w for w, _ in apart.values())


def test_all_columns_stay(spark):
    bench = spark.createDataFrame([(0, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "something else", "k", 5, "t"), (2, bench.first().text, "k", 6, "t")], "doc_id long, text string, _key string, key int, row string")
    assert [tuple(r) for r in D.clean(docs, bench).collect()] == [(1, "something else", "k", 5, "t")] and D.clean(docs, bench).columns == docs.columns
