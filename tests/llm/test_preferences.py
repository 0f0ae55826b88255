from tidewell.llm import preferences as pf


def brute(rows):
    convs = {}
    for c, n, r, t in set(rows):
        if c is not None and n is not None:
            convs.setdefault(c, []).append((n, r or "", t or ""))
    convs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    groups = {}
    for c in sorted(convs):
        groups.setdefault(convs[c][0], []).append(c)
    show = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)

    def mask(ts):
        out, at = [], 0
        for r, t in ts:
            whole = f"<|{r}|>\n{t}<|end|>\n"
            if r == "assistant":
                out.append(f"{at + len(r) + 5}:{at + len(whole)}")
            at += len(whole)
        return ",".join(out)

    out = []
    for g in groups.values():
        for i in range(0, len(g), 2):
            x, y = convs[g[i]], convs[g[i + 1]] if i + 1 < len(g) else None
            n = len(x) - 1 if y is None else 0
            if y is not None:
                while n < min(len(x), len(y)) and x[n] == y[n]:
                    n += 1
            out.append((g[i], None if y is None else g[i + 1], n, show(x[:n]), show(x[n:]), mask(x[n:]), None if y is None else show(y[n:]), None if y is None else mask(y[n:])))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.chosen_id, r.rejected_id, r.n_common, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) for r in df.collect()), key=str)


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello 🙂"), (2, 0, "user", "hi"), (2, 1, "assistant", "go away"), (2, 2, "user", "why"), (3, 0, "user", "hi"), (4, 0, "user", "solo"), (4, 1, "assistant", ""), (5, 1, None, None), (6, 3, None, None),
            (6, 4, "assistant", None), (7, 0, "assistant", "x"), (8, 0, "assistant", "x"), (None, 0, "user", "q"), (9, None, "user", "q"), (1, 0, "user", "hi"), (10, 1, "user", "tie"), (10, 1, "user", "a tie"), (11, 0, "assistant", "long " * 40000)]
    rows += [(c, t, "user", f"open {t}" if t < 2 else f"{c}") for c in range(100, 141) for t in range(3)]
    turns = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, n int")
    assert got(pf.report(turns)) == brute(rows)
    assert pf.report(turns.limit(0)).count() == 0


def test_given_pairs(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(1, 2), (2, 9), (9, 1)], "chosen long, rejected long")
    rows = {r.chosen_id: r for r in pf.format_pairs(pf.conversations(turns), pairs).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1].n_common, rows[1].prompt, rows[1].rejected) == (0, "", "<|user|>\nz<|end|>\n")
    assert (rows[2].rejected_id, rows[2].rejected, rows[2].n_common) == (None, None, 0)
    assert [tuple(s) for s in rows[1].chosen_mask] == [(len("<|user|>\na<|end|>\n<|assistant|>\n"), len("<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n"))]


def test_corpus(spark, sf_small):
    turns = spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert got(pf.report(turns)) == brute([tuple(r) for r in turns.collect()])
