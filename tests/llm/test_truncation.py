from memloom.llm import truncation as t


def test_automaton():
    assert t.still_open("a (b") and t.still_open("```json\n{\n") and t.still_open("bad \\u00") and t.still_open("broken �") and t.still_open("<a href=x")
    assert not t.still_open('fine (yes) "quoted" [x]') and not t.still_open("an opening ( of long ago\nnext line.") and not t.still_open("```\n{}\n```")


def texts():
    whole = ["The plan to walk the ridge was dropped.", "We moved the review to Tellow.", "Please keep the lamp near the door."]
    rows = [(i, " ".join(whole[(i + k) % 3] for k in range(3)), "notes") for i in range(60)]
    rows += [(100 + i, f"Note {i}. {whole[i % 3]} {whole[(i + 1) % 3]}\nBest,\nthe desk", "mail") for i in range(40)]
    cut = {200: ("We moved the review to Tellow. The plan to wa", "notes"), 201: ("Please keep the lamp near the", "notes"), 202: ("See (the", "notes"), 203: (f"{whole[0]} We moved the rev [clipped]", "mail")}
    fine = {300: ("We moved the review to Tellow. Please keep the lamp near the door", "notes"), 301: ("The plan to walk the ridge was dropped…", "notes"), 302: ("", "notes"), 303: ("  ", None)}
    return rows + [(k, *v) for k, v in {**cut, **fine}.items()] + [(400, None, "notes")], set(cut)


def test_found_and_shares(spark):
    rows, cut = texts()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, ending string")
    assert {r.doc_id for r in t.inspect(df).where("truncated").collect()} == cut
    got = {r.source: (r.texts, r.truncated) for r in t.shares(df).collect()}
    assert got == {"notes": (67, 3), "mail": (41, 1), "": (1, 0)}


def test_copies_do_not_vouch_for_themselves(spark):
    rows, cut = texts()
    rows += [(1000 + i, "We moved the review to the", "notes") for i in range(80)]
    found = {r.doc_id for r in t.inspect(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("truncated").collect()}
    assert found == cut | {1000 + i for i in range(80)}


def test_field_limit_and_announced_length(spark):
    rows, _ = texts()
    full = [(2000 + i, f"Note {i:03d}: " + "We moved the review to Tellow. " * 3, "sms") for i in range(12)]
    rows += [(k, x[:64] + "Tellow", "sms") for k, x, _ in full]  # all end alike, at the limit, in what could be an end
    df = spark.createDataFrame([(*r, 500 if r[0] == 5 else 70 if r[0] == 201 else None) for r in rows], "doc_id long, text string, source string, declared int")
    found = {r.doc_id for r in t.inspect(df, declared="declared").where("truncated").collect()}
    assert 5 not in found and 201 in found


def test_empty(spark):
    assert t.inspect(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_an_ending_is_known_by_how_often_sentences_go_on_after_it(spark):
    rows, cut = texts()
    names = [f"{a}{b}" for a in ("ar", "bel", "cor", "dun", "el") for b in ("ton", "wick", "ford", "mere", "ley")]
    rows += [(3000 + i, f"Please keep the blue suitcase near the door of {n}. Nobody in {n} objected.", "notes") for i, n in enumerate(names)]
    # A few sentences do end so, in texts of which one is repeated over and over.
    rows += [(3100 + i, f"In {names[i % 3]} we found and keep the blue suitcase. It was late.", "notes") for i in range(90)]
    rows += [(3300, "Nobody objected. Please keep the blue suitcase", "notes"), (3301, "It was late. In corton we found and keep the blue suitcase", "notes")]
    found = {r.doc_id for r in t.inspect(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("truncated").collect()}
    assert found == cut | {3300}


def test_common_words_are_no_own_ending_of_a_source_that_is_often_cut(spark):
    rows, cut = texts()
    names = [f"{a}{b}" for a in ("ar", "bel", "cor", "dun", "el") for b in ("ton", "wick", "ford", "mere", "ley")]
    full = [f"In {n} the owner of the lamp saw the clerk near the gate of the {m}. They left the {n} road to the {m} again." for n in names for m in names[:4]]
    rows += [(4000 + i, x, "drift") for i, x in enumerate(full)]
    short = [f"They saw {n} and left the lamp at {n} to look for the" for n in names]
    rows += [(4500 + i, x, "drift") for i, x in enumerate(short)]
    rows += [(4700 + i, f"In {n} they left the lamp. So long yours", "drift") for i, n in enumerate(names)]
    found = {r.doc_id for r in t.inspect(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("truncated").collect()}
    assert found == cut | {4500 + i for i in range(len(short))}


def test_an_open_or_broken_end_is_cut_whatever_length_was_announced(spark):
    ends = ["We moved the review (to Tel", "We moved the review to \\u00", "We moved the review to Tellow"]
    df = spark.createDataFrame([(i, x, "notes", len(x) + 2) for i, x in enumerate(ends)], "doc_id long, text string, source string, declared int")
    assert {r.doc_id for r in t.inspect(df, declared="declared").where("truncated").collect()} == {0, 1}


def test_the_result_does_not_depend_on_partitions(spark):
    rows, cut = texts()
    rows += [(5000 + i, "We moved the review to the", "notes") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [{tuple(r) for r in t.inspect(df.repartition(n, "doc_id")).collect()} for n in (1, 7)]
    assert found[0] == found[1] and {r[0] for r in found[0] if r[2]} >= cut


def test_keys_are_the_same_in_any_batch():
    ends = ["We keep the lamp near the door", "你好！我们明天见。早上好", "x " * 900 + "the end", "one"]
    alone = [t.ending_keys([x])[0] for x in ends]
    assert t.ending_keys(ends) == alone and t.ending_keys(ends[::-1]) == alone[::-1] and all(alone)
    assert t.ending_keys(["", "…"]) == [[], []]
