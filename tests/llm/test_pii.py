import pytest
from pyspark.sql import functions as F

from memloom.llm import pii

CASES = [
    ("call Ludo Wraxmoor on (555) 555-0101 if late", [("name", "Ludo Wraxmoor"), ("phone", "(555) 555-0101")]),
    ("cc a.b+c@mail.example and d-5 [at] x [dot] test", [("email", "a.b+c@mail.example"), ("email", "d-5 [at] x [dot] test")]),
    ("her ID is QQ 12 34 56 C.", [("id_number", "QQ 12 34 56 C")]),
    ("order 4412-6598-7755 has shipped, see note #55112233", []),
    ("if lost, return to Orla Finch, 12 Old Mill Road, Flat 2B", [("name", "Orla Finch"), ("address", "12 Old Mill Road")]),
    ("Paket bitte an Lindenauer Straße 18a, Tel. +49 30 23125700", [("address", "Lindenauer Straße 18a"), ("phone", "+49 30 23125700")]),
    ("quedamos en Calle del Olmo 12, 3.º B", [("address", "Calle del Olmo 12")]),
    ("快递请寄到澄阳市云屏区柳荫路75号，到了打１２０ ５８２２ ９８５８", [("address", "澄阳市云屏区柳荫路75号"), ("phone", "１２０ ５８２２ ９８５８")]),
    ("门锁了就打120-8971-2813找澹台景珩!", [("phone", "120-8971-2813"), ("name", "澹台景珩")]),
    ("dr. orla finch moved the appointment", [("name", "orla finch")]),
    ("It took 44 minutes to walk from Caldmere", []),
    ("the 74th Street café was shut", []),
    ("证件号：990197199001011234，别外传", [("id_number", "990197199001011234")]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    got = [(pii.LABELS[lab], text[a:b]) for a, b, lab in pii.Tagger().tag(text)]
    assert got == want
    assert not want or pii.gate_python(text)


def test_skip_edge_carries_a_label_to_a_far_mention():
    text = "Dr. Ravenna moved the appointment. " + "Nothing else happened here. " * 20 + "Later Ravenna rang."
    got = pii.Tagger().tag(text)
    assert [text[a:b] for a, b, _ in got] == ["Ravenna", "Ravenna"]
    # The second mention alone speaks against a name (here by a low prior); the edge outweighs that.
    for t, found in ((pii.Tagger(prior=-3.0), 2), (pii.Tagger(prior=-3.0, skip=0.0, chain=0.0), 1)):
        assert [text[a:b] for a, b, _ in t.tag(text)] == ["Ravenna"] * found
    near = "Dr. Smith moved the appointment. Smyth rang later"
    assert [near[a:b] for a, b, _ in pii.Tagger().tag(near)] == ["Smith", "Smyth"]


def test_alike_words_are_linked_and_not_others():
    words = ["smith", "smyth", "brown", "smiths", "smith", "al", "el"]
    assert set(pii.alike(words)) == {(0, 4), (0, 1), (0, 3)}


def test_all_near_words_are_linked_however_many_share_a_beginning_or_end():
    import itertools
    import random

    blanked = lambda w: {(w[:k], w[k + 1 :]) for k in range(len(w))}
    shorter = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}
    rnd = random.Random(3)
    crowd = ["ravenna", *("ra" + c * 3 + "na" for c in "bcdfghjklm"), "ravanna"]
    mixed = list({"ra" + "".join(rnd.choice("abé中") for _ in range(rnd.randint(2, 5))) + "na" for _ in range(300)})
    for words in (crowd, mixed, [f"555{i:04}" for i in range(300)]):
        want = {frozenset((i, j)) for (i, x), (j, y) in itertools.combinations(enumerate(words), 2) if blanked(x) & blanked(y) or x in shorter(y) or y in shorter(x)}
        got = pii.alike(words)
        assert {frozenset(e) for e in got} == want and len(got) == len(want) > 0
    # The edge decides in a text: ten other words begin and end as the two do.
    text = "Dr. Ravenna moved the appointment. " + " ".join(f"The train to {w.title()} was late." for w in crowd[1:-1]) + " Later Ravanna rang."
    assert [text[a:b] for a, b, _ in pii.Tagger(prior=-3.0).tag(text)] == ["Ravenna", "Ravanna"]


def test_a_node_may_have_any_number_of_edges():
    text = "Dr. Ravenna moved the appointment. " + "Later Ravenna rang. " * 1500
    assert [text[a:b] for a, b, _ in pii.Tagger().tag(text)] == ["Ravenna"] * 1501


def test_loopy_messages_agree_with_exact_sums_on_a_tree():
    import itertools

    import numpy as np

    t = pii.Tagger(rounds=20)
    nodes = ((0.0, -1, 0.4, 0.3, -9, -9), (0.1, -9, -9, 0.2, -9, 0.3), (0.0, -9, 0.2, -9, -9, 0.1))
    best = np.zeros((3, 6))
    for x in itertools.product(range(6), repeat=3):
        w = np.exp(sum(nodes[i][x[i]] for i in range(3))) * t._near[x[0], x[1]] * t._near[x[1], x[2]]
        for i in range(3):
            best[i, x[i]] += w
    assert t._infer(nodes, ()) == tuple(best.argmax(1))


def test_gate_loses_nothing_and_text_is_redacted(spark):
    rows = [(i, t, "clash") for i, (t, _) in enumerate(CASES)] + [(100, None, ""), (101, "plain words " * 5000, "")]
    df = spark.createDataFrame(rows, "k long, t string, start_pos string")
    found = {(r.k, r.pii_type, r.start_pos) for r in pii.find(df, "k", "t").collect()}
    assert found == {(i, kind, t.index(x)) for i, (t, want) in enumerate(CASES) for kind, x in want}
    out = {r.k: r.t for r in df.select("k", pii.redacted(F.col("t")).alias("t")).collect()}
    assert out[0] == "call [NAME] on [PHONE] if late" and out[100] is None and out[3] == CASES[3][0]
    assert pii.find(df.limit(0), "k", "t").count() == 0


FREE = [
    ("We met Anna Smith today near the station", ["Anna Smith"]),
    ("See the notes.\nRegards,\nAnna Smith", ["Anna Smith"]),
    ("I'm Anna and this is my first day", ["Anna"]),
    ("Thanks, Jo. Later Jo left.", ["Jo", "Jo"]),
    ("昨天遇到王小明，聊了很久", ["王小明"]),
    ("The Vermieter said no, and we met in Bramford on Monday", []),
    ("Someone asked for the bowl. Der Vermieter fragt nach dem Topf.", []),
]


@pytest.mark.parametrize(("text", "want"), FREE)
def test_names_outside_of_frames(text, want):
    assert [text[a:b] for a, b, lab in pii.Tagger().tag(text) if pii.LABELS[lab] == "name"] == want
    assert not want or pii.gate_python(text)


def test_gate_reads_names_outside_of_frames_as_python_does(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FREE)], "k long, t string")
    assert {(r.k, r.start_pos) for r in pii.find(df, "k", "t").collect()} == {(i, a) for i, (t, _) in enumerate(FREE) for a, _, _ in pii.Tagger().tag(t)}


def test_memories_come_out_redacted(spark, tmp_path):
    from memloom.llm.queries import QUERIES

    rows = [(f"m{i}", t) for i, (t, _) in enumerate(CASES)] + [("null", None)]
    spark.createDataFrame(rows, "memory_id string, content string").write.parquet(str(tmp_path / "memories.parquet"))
    out = {r.memory_id: r.content for r in QUERIES["p6_redacted_memories"](spark, str(tmp_path)).collect()}
    assert len(out) == len(rows) and out["m0"] == "call [NAME] on [PHONE] if late" and out["null"] is None and out["m3"] == CASES[3][0]


#: Sentences in frames that the sample has none of, with names it has not.
HELD_OUT = [
    ("Yesterday afternoon Gregor Lindqvist dropped off two boxes.", ["Gregor Lindqvist"]),
    ("The flowers came from Beatrix and her cousin.", ["Beatrix"]),
    ("Has anyone heard from Oswald Pembridge lately?", ["Oswald Pembridge"]),
    ("According to my aunt Henrietta, soup helps.", ["Henrietta"]),
    ("Wanda Kowalczyk and Siobhan Doyle booked the hall.", ["Wanda Kowalczyk", "Siobhan Doyle"]),
    ("Let's surprise Benedikt with a cake!", ["Benedikt"]),
    ("Cornelius forgot his umbrella again.", ["Cornelius"]),
    ("Minutes taken by Rosalind Achebe.", ["Rosalind Achebe"]),
    ("Would Theodora like the blue one?", ["Theodora"]),
    ("We owe Percival Strand forty euros.", ["Percival Strand"]),
    ("Happy to hear that Ingrid Solberg passed her exam.", ["Ingrid Solberg"]),
    ("Mrs. Abernathy fed the cat.", ["Abernathy"]),
    ("La vecina Remedios Quintana riega las plantas.", ["Remedios Quintana"]),
    ("Creo que Leandro se ha ido ya.", ["Leandro"]),
    ("El martes cené con Eulalia Bermúdez.", ["Eulalia Bermúdez"]),
    ("Felicita a Anselmo de mi parte.", ["Anselmo"]),
    ("Meine Tante Roswitha backt Brot.", ["Roswitha"]),
    ("Kannst du Hartmut Ziegler Bescheid geben?", ["Hartmut Ziegler"]),
    ("Friederike und Konstantin ziehen um.", ["Friederike", "Konstantin"]),
    ("Herr Doppler wartet unten.", ["Doppler"]),
    ("刚才孙志远打来电话了。", ["孙志远"]),
    ("下午和林婉清一起去。", ["林婉清"]),
    ("请转告赵立新。", ["赵立新"]),
    ("韩雪梅说钥匙在门口。", ["韩雪梅"]),
    ("The ferry to Brindlemouth leaves at six.", []),
    ("Our cottage near Oakenshaw has no heating.", []),
    ("Silver Otter was renamed in spring.", []),
    ("Under Crimson Ferry nobody kept notes.", []),
    ("Microsoft changed the login page.", []),
    ("Every Thursday the choir meets in Halvergate.", []),
    ("Please bring Towels and Sunscreen.", []),
    ("Die Rechnung der Werkstatt liegt im Handschuhfach.", []),
    ("Unser Ausflug nach Steinhagen fällt aus.", []),
    ("Bitte Zucker, Mehl und Butter kaufen.", []),
    ("El tren de Villafranca llega tarde.", []),
    ("Aquel informe sobre Puente Rojo era largo.", []),
    ("石头剪刀布", []),
    ("白菜和黄瓜都没了", []),
    ("马上就到，谢谢！", []),
    ("高铁晚点了", []),
]


def test_held_out_sentences():
    t = pii.Tagger()
    want = [(i, a) for i, (_, names) in enumerate(HELD_OUT) for a in names]
    got = [(i, x[a:b]) for i, (x, _) in enumerate(HELD_OUT) for a, b, lab in t.tag(x) if pii.LABELS[lab] == "name"]
    right = len(set(want) & set(got))
    assert right / len(want) >= 0.5 and right / len(got) >= 0.8  # measured: 0.54, 0.88
    from memloom.llm.pii_sample import FAMILY, GIVEN, NAMED, OTHERS

    assert not {w for n in want for w in n[1].split()} & {*GIVEN, *FAMILY} and not {x for x, _ in HELD_OUT} & {*NAMED, *OTHERS}
