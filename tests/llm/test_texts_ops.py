import random

from seamline.llm import endings, leakage, pairs, tokenize, truncation

DOCS = "doc_id long, text string, source string, bytes int, seq string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, "clash") for i, (t, s) in enumerate(rows)], DOCS)


def test_tokens_round_trip_and_reference(spark):
    import tiktoken

    texts = ["", None, "  two  spaces \n\n\n x", "it's <|endoftext|> here", "नमस्ते दुनिया 12½ 🏏👨‍👩‍👧", "\t\x00\x1c\x85​ x", "a" * 20000, "the the the", "the the the", " " * 300 + "!"]
    enc = tiktoken.Encoding("t", pat_str=tokenize.PATTERN, mergeable_ranks=tokenize.load_ranks(tokenize.vocabulary_path()), special_tokens={})
    d = docs(spark, [(t, "s") for t in texts])
    want = sorted((i, enc.encode_ordinary(t or "")) for i, t in enumerate(texts))
    for few in (500_000, 0):  # broadcast and salted shuffle
        assert sorted((r.doc_id, list(r.ids)) for r in tokenize.encode(d, broadcast_words=few).collect()) == want
    twice = docs(spark, [("x y", "s")]).union(docs(spark, [("x y", "s")]))
    assert tokenize.encode(twice).count() == 2 and tokenize.encode(d.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in tokenize.decode(tokenize.encode(d)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def passage(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.choice(['al', 'en', 'or', 'it'])}{rng.choice(['ter', 'ming', 'sel', 'ord'])}{rng.randrange(99)}" for _ in range(n)]


def test_leaks_of_wholes_parts_and_edits(spark):
    rng = random.Random(3)
    items = [passage(rng, 60) for _ in range(20)]
    text = lambda w: " ".join(w)
    fill = lambda n: text(passage(rng, n))
    edited = [w if k % 10 else "changed" for k, w in enumerate(items[1])]
    rows = [
        (fill(30) + " " + text(items[0]) + " " + fill(9), "a"),
        (fill(30) + " " + text(edited).upper().replace(" ", " - \n> "), "a"),
        (text(items[2][:18]) + ". " + fill(40) + " " + text(items[2][30:48]), "a"),
        (fill(20) + " " + text(items[3][:12]) + " " + fill(20), "a"),
        ("<p>" + text(items[4][20:56]).replace(" ", "</b> <b>") + "</p>", "a"),
        (None, "a"), ("", "a"), ("  ", "a"), (fill(300), "a"), (text(items[0]), "a"), (text(items[0]), "a"),
        (text(reversed(items[5])), "a"), (fill(4000) + " " + text(items[6]) + " " + fill(4000), "a"),
    ]
    it = spark.createDataFrame([(100 + k, text(w)) for k, w in enumerate(items)] + [(999, None)], "item_id long, text string")
    got = {tuple(r) for r in leakage.leaks(docs(spark, rows), it).collect()}
    assert got == {(100, 0), (101, 1), (102, 2), (104, 4), (100, 9), (100, 10), (106, 12)}
    assert {tuple(r) for r in leakage.leaks(docs(spark, rows), it, block_chars=500).collect()} == got
    assert leakage.leaks(docs(spark, rows).limit(0), it).count() == 0 and leakage.leaks(docs(spark, rows), it.limit(0)).count() == 0


def test_leaks_of_many_stretches_and_of_short_items(spark):
    rng = random.Random(8)
    a = passage(rng, 60)
    decoys = [" ".join(a[k : k + 10]) + " " + " ".join(passage(rng, 15)) for k in (0, 2, 4, 6, 8, 1, 3, 5, 7)]
    rows = [(" ".join(decoys), "s"), (" ".join(decoys) + " " + " ".join(a[20:34]) + " " + " ".join(passage(rng, 15)) + " " + " ".join(a[40:58]), "s"), ("well, Bo Li is out! said he", "s"), ("bo lit", "s"), ("no ball again", "s")]
    it = spark.createDataFrame([(100, " ".join(a)), (101, "Bo, LI"), (102, "No ball again."), (103, "no ball agains")], "item_id long, text string")
    got = {tuple(r) for r in leakage.leaks(docs(spark, rows), it).collect()}
    assert got == {(100, 1), (101, 2), (102, 4)}


def test_stack_automaton():
    assert endings.unclosed('<div>he said "yes') == ["div", '"'] and endings.unclosed("<p>a (b [c]) d</p>") == []
    assert endings.unclosed("a ) b<br>c") == [] and endings.unclosed("") == []
    assert endings.is_terminated('He said "no."') and endings.is_terminated("Done.</p> 🏏") and not endings.is_terminated("half a")
    assert endings.is_terminated("&quot;It worked.&quot;") and not endings.is_terminated("worked &quo")


def test_cut_texts(spark):
    whole = "The captain praised the slower ball and the crowd waved its scarves at the river end."
    rng = random.Random(5)
    rows = []
    for i in range(300):
        body = " ".join(rng.choice(["The captain praised the slower ball.", "The crowd waved its scarves at the river end.", "Both sides blamed the heavy roller after tea.", "Between overs the keeper welcomed the new ball."]) for _ in range(4))
        if i % 3 == 0:
            rows.append((body[:100], "short"))
        elif i % 3 == 1:
            rows.append((body + " Umpires: A Name", "clean"))
        else:
            rows.append((body, "clean"))
    n = len(rows)
    rows += [(body + " Between overs the kee", "clean"), (whole[:-20] + "&quo", "clean"), (None, "clean"), ("", None), ("   ", "clean"), ("x", None), (body, None), (body, None)]
    d = docs(spark, rows)
    got = {r.doc_id for r in truncation.truncated(d).collect()}
    short = {i for i, (t, s) in enumerate(rows) if s == "short" and not t.rstrip().endswith(".")}
    assert short <= got and {n, n + 1} <= got
    assert not {i for i, (t, s) in enumerate(rows[:n]) if s == "clean"} & got and not {n + 2, n + 3, n + 4, n + 6, n + 7} & got
    assert truncation.truncated(d.limit(0)).count() == 0
    r = {x.source: x for x in truncation.source_report(d).collect()}
    assert r["short"].share_cut > 0.8 and r["clean"].n_cut == 2


GEN = "gen_id long, linearized_input string, reference string, generation string, rate double"


def generations(spark, n=240):
    rng = random.Random(2)
    names = [f"{rng.choice('ABC')} {rng.choice(['Bor', 'Kel', 'Mav', 'Tor'])}{rng.choice(['ant', 'ish', 'ley', 'wick'])}" for _ in range(30)]
    rows, want = [], {}
    for i in range(n):
        a, b = rng.sample(names, 2)
        src = f"over={i % 20}.{1 + i % 6} | batter={a} | bowler={b} | outcome=FOUR | runs=4 | score={40 + i}/2 | wkts_in_hand=8 | phase=middle | momentum=9"
        line = lambda: f"{a} drives {b} through the covers for four. The {rng.choice(['quick', 'slow', 'short'])} ball sat up and the crowd at the river end waved its scarves. {a} looks {rng.choice(['content', 'rattled', 'untroubled'])} and the field goes back."
        ref, gen, kind = line(), line(), None
        if i % 12 == 1:
            gen, kind = rng.choice([None, "", "  ", "N/A", "<p></p>", "...", "null"]), "empty"
        elif i % 12 == 3:
            gen, kind = rng.choice(["I'm sorry, but I cannot describe this ball.", "Unfortunately I am unable to help with that request. Thank you for understanding."]), "refusal"
        elif i % 12 == 5:
            gen, kind = rng.choice([src, src.upper(), src.replace("=", ": ").replace(" | ", "\n"), "Input: " + src]), "copy"
        elif i % 12 == 7:
            gen, kind = rng.choice(["Der Ball fliegt weit über das Feld und die Zuschauer springen auf.", "La pelota vuela por encima de la cuerda y nadie puede alcanzarla.", f"{b} की अच्छी गेंद, बल्लेबाज़ के पास कोई जवाब नहीं था।"]), "language"
        elif i % 12 == 9:
            gen, kind = gen[: gen.index("scarves") - rng.choice([3, 4, 8])], "truncated"
        elif i % 12 == 11:
            gen = gen.rstrip(".")
        rows.append((i, src, ref, gen, 0.5))
        if kind:
            want[i] = kind
    return spark.createDataFrame(rows, GEN), want


def test_pair_defects_held_out(spark):
    g, want = generations(spark)
    got = {r.gen_id: r.defect for r in pairs.defects(g, train_rows=120).collect()}
    wrong = {i for i in range(240) if got.get(i) != want.get(i)}
    assert len(wrong) <= 5, {i: (got.get(i), want.get(i)) for i in wrong}
    assert pairs.defects(g.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, 0.0), (1, None, None, None, 0.0), (2, None, None, "x" * 30000, 0.0)], GEN)
    assert sum(r.defect == "empty" for r in pairs.defects(odd).collect()) == 2


def test_field_learns_transitions():
    f = pairs.Field(4, 2).fit([[[0], [1], [1]], [[0], [1]], [[2], [3]]], [[0, 1, 1], [0, 1], [1, 0]], rounds=300)
    assert f.decode([[0], [1]]) == [0, 1] and f.decode([[2], [3]]) == [1, 0]


def test_texts_cut_and_marked(spark):
    assert not endings.is_terminated("half a…") and not endings.is_terminated("<p>half a [...]</p>") and not endings.is_terminated("half a &hellip;")
    assert endings.is_terminated('"Half a…"') and endings.is_terminated("Well… done.") and endings.end_of("half a…") == endings.end_of("half a")
    rng = random.Random(6)
    said = ["The captain praised the slower ball.", "The crowd waved its scarves at the river end.", "Both sides blamed the heavy roller after tea.", "Between overs the keeper welcomed the new ball."]
    rows = []
    for i in range(200):
        body = " ".join(rng.choice(said) for _ in range(rng.randrange(1, 6)))
        rows.append((body if len(body) <= 100 else body[:99].rstrip() + "…", "digest") if i % 2 else (body, "clean"))
    n = len(rows)
    rows += [("Between overs the keeper welc...", "clean"), ("The crowd waved its scarves…", "clean"), ("Both sides blamed the heavy roller after tea...", "clean")]
    want = {i for i, (t, s) in enumerate(rows[:n]) if t.endswith("…")}
    assert len(want) > 30 and {len(rows[i][0]) for i in want} == {99, 100}
    got = {r.doc_id for r in truncation.truncated(docs(spark, rows)).collect()}
    assert got == want | {n, n + 1}


def test_texts_cut_within_quotes_brackets_and_tags(spark):
    said = ["The captain praised the slower ball.", "The crowd waved its scarves at the river end.", "Both sides blamed the heavy roller after tea.", "Between overs the keeper welcomed the new ball."]
    rng = random.Random(7)
    body = lambda: " ".join(rng.choice(said) for _ in range(rng.randrange(2, 5)))
    rows = [(("<p>" if i % 2 else "") + body(), "loose" if i % 2 else "strict") for i in range(120)]
    end = " The crowd waved its scarves at the river end"
    rows += [(body() + end, "strict"), (body() + ' They said "we' + end, "strict"), (body() + " (as usual" + end, "strict"), ("<div>" + body() + end, "strict"), ("<p>" + body() + end, "loose"), (body() + " [" + end, "loose")]
    got = {r.doc_id for r in truncation.truncated(docs(spark, rows)).collect()}
    assert got == {121, 122, 123, 125}
