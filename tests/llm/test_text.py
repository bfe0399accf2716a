import itertools
import json
import random

import pytest

from palimpsest.llm import formatting_dedup, pii, residue

from ..frames import documents, memories
from .residue_sentences import CLEAN, SEEN, UNSEEN

PARTS = (("Liora", "given"), ("Mark", "given"), ("Hazel", "given"), ("Skarsen", "family"), ("Stone", "family"), ("Frost", "family"), ("Grant", "given"), ("Ashgrove-Lint", "family"), ("Țeromir", "family"))


def items(text):
    return {k: i for k, i in pii.scan_text(text, pii._names(PARTS))[1]}


@pytest.mark.parametrize(
    "text,want",
    [
        ("mail a.b+c@box.test now", {"email": "abcboxtest"}),
        ("mail a.b (at) box (dot) test now", {"email": "abatboxdottest"}),
        ("mail liora.stone at box dot test once", {"email": "liorastoneatboxdottest"}),
        ("Reply goes to x1＠box.test.", {"email": "x1boxtest"}),
        ("Pin the package to abc@2.2.2. Mention @handle there.", {}),
        ("Ring +49 (0)30 23125 652 after lunch", {"phone": "4903023125652"}),
        ("tel 776 555‑0130 or so", {"phone": "7765550130"}),
        ("Ticket 942-727-9682 moved. Sensor at 10.141.140.169 is silent.", {}),
        ("Holder gave SSN 920-92-9193.", {"id_number": "920929193"}),
        ("703-44-7591 is out of stock. Part no. K610-7600-4217. Batch 43647245577 weighs 2 kilos.", {}),
        ("NI number=QQ18 96 28 A; shelf=190", {"id_number": "qq189628a"}),
        ("Home is Flat 13, 100 Bellfield Ave, Oxmoor QX3 5ZZ; then go", {"address": "flat13100bellfieldaveoxmoorqx35zz"}),
        ("Home is 47 alder street apt 38 fennick; ok", {"address": "47alderstreetapt38fennick"}),
        ("now at Am Steinbruch 25, 90500 Brunnfelde. Next", {"address": "amsteinbruch2590500brunnfelde"}),
        ("The Tannery Street depot opens. Room 80, building 2, has a lock", {}),
        ("Spoke with Mr. Skarsen about it", {"name": "skarsen"}),
        ("Contact: Skarsen, Liora, x@box.test.", {"name": "skarsenliora", "email": "xboxtest"}),
        ("Liora M. Plumtrey asked for a copy", {"name": "lioramplumtrey"}),
        ("A grant will mark the frost on the stone wall. A GRANT WILL MARK THE FROST ON THE STONE WALL.", {}),
        ("A Grant Will Mark The Frost On The Stone Wall.", {}),
        ("Spoke with Hazel Stone about it", {"name": "hazelstone"}),
        ("Vepozeku Figelizu is the name of the release, dot zero comes first", {}),
        ("", {}),
        ("x" * 200_000, {}),
    ],
)
def test_items(text, want):
    assert items(text) == want


def test_validators():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.mod23("12345678Z") and not pii.mod23("12345678A")
    assert pii.mod11_10("86095742719") and not pii.mod11_10("86095742718")


#: (text, scheme, number, a number that differs in one digit or letter)
NEAR_MISSES = [
    ("Her document {} lies in the drawer", "mod23", "12345678Z", "12345678A"),
    ("resident {} came by", "mod23", "X1234567L", "X1234567M"),
    ("tax file {} was sent", "mod11_10", "86095742719", "86095742718"),
    ("the holder of {} asked", "luhn", "046 454 286", "046 454 287"),
    ("identity {} is on the card", "mod97", "2 55 08 14 168 025 38", "2 55 08 14 168 025 39"),
    ("national {} it says", "mod97", "85.07.30-033.28", "85.07.30-033.29"),
    ("his id is {} I think", "nino", "AB 12 34 56 C", "GB 12 34 56 C"),
]


@pytest.mark.parametrize("text,scheme,good,bad", NEAR_MISSES)
def test_checksums_decide_without_a_label(text, scheme, good, bad, monkeypatch):
    assert items(text.format(good)).get("id_number") == pii._squeeze(good)
    assert "id_number" not in items(text.format(bad))
    assert "id_number" not in items(f"Lunch at noon, then {good} again")  # valid by chance: nothing speaks of identity
    assert "id_number" not in items(f"id of batch {good}")
    monkeypatch.setitem(pii.VALIDATORS, scheme, lambda _: False)
    assert "id_number" not in items(text.format(good))
    monkeypatch.setitem(pii.VALIDATORS, scheme, lambda _: True)
    assert items(text.format(bad)).get("id_number") == pii._squeeze(bad)


def test_a_label_outweighs_a_failed_checksum():
    assert items("DNI 12345678A was shown") == {"id_number": "12345678a"}
    assert items("social security number 123-45-6789 on file") == {"id_number": "123456789"}


def test_names_by_look_up_of_many_parts():
    parts = tuple((f"Zu{a}{b}{c}nek", "family") for a in "abcdefghij" for b in "klmnopqrst" for c in "aeiou") + PARTS
    text = "We met Liora Zuaklnek and Liora Zuakanek, then Liora Ashgrove-Lint; A. Țeromir wrote. " * 50
    names = pii._names(parts)
    assert {i for _, i in pii.scan_text(text, names)[1]} >= {"liorazuakanek", "lioraashgrovelint", "ațeromir"}
    assert ["Ashgrove-Lint", "Stone"] == ["xLiora Ashgrove-Lint, Liora2 Stone"[a:b] for a, b in names._known("xLiora Ashgrove-Lint, Liora2 Stone")]


def test_redaction_keeps_the_rest(spark):
    names = spark.createDataFrame([*PARTS, (None, "given"), (" ", None)], "name_part string, part_kind string")
    meta = '{"n": 5, "e\\u00e9": "ask liora skarsen", "tel": "+33 1 99 00 67 21",  "k": true}'
    m = memories(spark, [{"id": "a", "content": "mail a@box.test.\nEnd", "metadata_json": meta}, {"id": "a", "content": "mail a@box.test.\nEnd"}, {"id": "b", "content": None, "metadata_json": '{"x": "a@bo'}, {"id": None, "content": "tel +33 1 99 00 67 21"}])
    out = {(r["id"], r["metadata_json"]): r["content"] for r in pii.redact(m, names).collect()}
    assert out[("a", None)] == "mail [EMAIL].\nEnd" and out[(None, None)] == "tel [PHONE]"
    (redacted,) = [k[1] for k in out if k[0] == "a" and k[1]]
    assert json.loads(redacted) == {"n": 5, "eé": "ask [NAME]", "tel": "[PHONE]", "k": True} and redacted.startswith('{"n": 5, "e\\u00e9"')
    found = [tuple(r) for r in pii.personal_items(m, names).collect()]
    assert sorted(found) == [("a", "content", "email", "aboxtest"), ("a", "metadata_json", "name", "lioraskarsen"), ("a", "metadata_json", "phone", "33199006721")]
    assert pii.personal_items(m.limit(0), names).count() == 0
    assert pii.personal_items(m, names.limit(0)).count() == 2


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Hello, World!", "  hello   WORLD​", True),
        ("runs at -9 degrees", "runs at 9 degrees", False),
        ("took 17.9 hours", "took 179 hours", False),
        ("a b c", "b a c", False),
        ("k: A 1, v: 2", '{"v": 2, "k": "a 1"}', True),
        ("k=a; v=2", "{v: 2\nk: a}", True),
        ("start: x, stop: y", "start: y, stop: x", False),
        ("- item one", "item one", True),
        ('{"a": {"b": 1, "c": [1, 2]}}', '{"a": {"c": [1, 2], "b": 1}}', True),
        ('{"a": [1, 2]}', '{"a": [2, 1]}', False),
        ("1 23", "12 3", False),
        ("Café", "CAFÉ", True),
    ],
)
def test_canonical(a, b, same):
    assert (formatting_dedup.canonical(a) == formatting_dedup.canonical(b)) is same


@pytest.mark.parametrize("partitions", [1, 7])
def test_formatting_copies(spark, partitions):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        base = rng.choice(["the hot text", "the hot text", "a", "b 1", "k: 1, v: 2", ""])
        rows.append({"id": f"{i:03d}", "tenant_id": rng.choice(["t", None]), "content": rng.choice([base.upper(), base + " .", f"  {base}"])})
    rows += rows[:10] + [{"id": None, "content": "a"}, {"id": "zz", "content": None}]
    m = memories(spark, rows)
    groups = {}
    for r in rows:
        if r["id"] is not None and r["content"] is not None:
            groups.setdefault((r.get("tenant_id", "t"), formatting_dedup.canonical(r["content"])), []).append(r["id"])
    want = {(min(g), i) for g in groups.values() for i in set(g) - {min(g)}}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = [tuple(r) for r in formatting_dedup.formatting_copies(m).collect()]
        counts = {(r["tenant_id"], r["first_id"]): (r["n_ids"], r["n_rows"]) for r in formatting_dedup.collapse(m).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(set(got)) and set(got) == want
    assert counts == {(k[0], min(g)): (len(set(g)), len(g)) for k, g in groups.items()}
    assert formatting_dedup.formatting_copies(m.limit(0)).count() == 0


def test_collapse_keeps_groups_of_one_id_apart(spark):
    m = memories(spark, [{"id": i, "content": c} for i, c in [("a", "first text"), ("a", "second text"), ("b", "first text"), ("c", "second text"), ("d", "second text")]])
    assert sorted((r["first_id"], r["n_ids"], r["n_rows"]) for r in formatting_dedup.collapse(m).collect()) == [("a", 2, 2), ("a", 3, 3)]


HIT = [
    "Dear {{ name }}, hello", "Regards, ${user.email}", "arrives on #{date}.", "<%= order.total %> now", "{% city %} x", "see [[TITLE]] there", "@@due_date@@", "__first_name__ came", "%first_name% came",
    "$имя$ came", "Dear [TITLE], hi", "Dear [ ], hi", "[insert city here] came", "[TBD]", "Your &lt;company&gt; came", "Dear <recipient>, hi", "{0} came", "%1$s came", "XXXX came", "the ________ came", "[object Object] came",
    "Lorem ipsum dolor sit amet.", "Nulla fugiat cillum dolore veniam elit sed.", "asdf asdf jkl", "blah blah blah blah", "Your headline here", "This is a placeholder paragraph.", "Platzhaltertext, bitte ersetzen.",
    "404 Not Found", "HTTP 503 - Service temporarily down", "Access denied. You do not have permission", "Traceback (most recent call last): x", "java.lang.NullPointerException at a.b(a.java:3)", "Fehler 503: Seite nicht gefunden.",
    "Bad gateway.", "Сервер временно недоступен.", "Please enable JavaScript to continue.", "Diese Seite benötigt JavaScript.", "Votre navigateur n'exécute pas les scripts.",
]
MISS = [
    None, "", "   ", "Prices in [brackets] are per kilo.", "The set {1, 2, 33} has three elements, and 50 % of readers know it.", "Printers say lorem ipsum when they mean 84 lines of filler text.",
    "The clerk found error 143 in the ledger.", "The JavaScript course costs 35 coins.", "Lesson 7 shows how a server answers with code 404 when a page is missing.", "Access to the cellar was denied to 9 visitors.",
    "The old gate was not found until 56 people searched.", "Use `{{ name }}` in a template.", "```\n{{ name }}\n```\nThat is all.", "A placeholder like {{ name }} is written with braces, for example.", "<h1>Real title</h1> and <b>bold</b>.",
    "Der Schreiber fand Fehler 637 im Kassenbuch.", "a [link](http://x.y) here", "one two three four " * 30_000,
]


@pytest.mark.parametrize("text,want", [*((t, True) for t in HIT), *((t, False) for t in MISS)])
def test_residue(text, want):
    assert any(residue.residue(text)) is want


@pytest.mark.parametrize("text", ["Duis aute irure dolor in reprehenderit in voluptate velit esse", "Excepteur sint occaecat cupidatat non proident"])
def test_latin_filler_without_hints(text):
    assert residue.residue(f"Our office. {text}.")[1]


def test_residue_around_code():
    assert residue.residue("``` Dear {{first_name}}, welcome")[0] and residue.residue("<code> Dear {{first_name}}")[0]
    assert residue.residue("```a``` Dear {{first_name}} ```b")[0] and not residue.residue("```Dear {{first_name}}``` and `{{x}}` <pre>{{y}}</pre>")[0]
    assert residue.residue("<pre>404 Not Found</pre>")[2] and residue.residue("``` lorem ipsum dolor")[1]
    assert residue.residue("<samp>Please enable JavaScript</samp>")[3]


def test_residue_frames(spark):
    d = documents(spark, [(1, "404 Not Found"), (1, "404 Not Found"), (2, "fine"), (3, None), (None, "404 Not Found"), (None, "fine"), (4, "fine. " * 50 + "Dear {{ name }}")])
    assert sorted(r["doc_id"] for r in residue.residue_documents(d).collect()) == [1, 4]
    assert residue.residue_flags(d).count() == 7
    assert sorted(r["doc_id"] for r in residue.without_residue(d.where("doc_id IS NOT NULL")).collect()) == [2, 3]
    assert residue.residue_documents(d.limit(0)).count() == 0
    assert list(itertools.chain(residue.without_residue(d).columns)) == d.columns


def test_residue_in_sentences_that_no_table_holds():
    assert all(any(residue.residue(t)) for t in SEEN) and not any(any(residue.residue(t)) for t in CLEAN)
    assert sum(any(residue.residue(t)) for t in UNSEEN) >= 0.8 * len(UNSEEN)
    beside = "The ferry left at nine. " * 30
    assert all(any(residue.residue(beside + t)) for t in SEEN)
