"""Tags against a plain stack."""

import random
import re

from pyspark.sql import functions as F

from picmeta.functions import markup

TOKEN = re.compile(markup.TOKEN.replace("*+>", "*>"))


def plain(text):
    if text is None:
        return None
    open_, out = [], []
    for nth, m in enumerate(TOKEN.finditer(text)):
        t = m[0]
        name = (re.match(r"</?([A-Za-z][^\s/>]*)", t) or [None, ""])[1].lower()
        starts = [("<!--", "comment"), ("<![CDATA[", "cdata"), ("<?", "instruction"), ("<!", "declaration"), ("</", "close")]
        kind = next((k for s, k in starts if t.startswith(s)), None) or ("raw" if name in ("script", "style") else "empty" if name in markup.VOID or t.endswith("/>") else "open")
        top = open_[-1] if open_ else (None, None, None)
        closes = parent = None
        depth, implied, declared, attributes = len(open_), 0, top[2], ""
        if kind == "close":
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if at is None:
                kind, parent = "stray", top[1]
            else:
                closes, implied, depth = open_[at][1], len(open_) - 1 - at, at
                parent = open_[at - 1][1] if at else None
                open_ = open_[:at]
        else:
            parent = top[1]
            if kind in ("open", "empty", "raw"):
                own = re.search(r"""\slang\s*=\s*(?:"([^"]*)"|'([^']*)')""", t)
                declared = (own and (own[1] or own[2])) or top[2]
                tag = re.match("<[^>]*>", t)[0] if kind == "raw" else t
                pairs = re.findall(markup.ATTRIBUTE, tag)
                attributes = " ".join(f'{n}="{v[1:-1]}"' for n, v in sorted(pairs, key=lambda p: p[0].encode("utf-16-be")))
            if kind == "open" and len(open_) < markup.DEEPEST:
                open_ = [*open_, (name, nth, declared)]
        out.append((nth, kind, name if kind in ("open", "empty", "raw", "close", "stray") else None, m.start(), len(t), depth, parent, closes, implied, declared, attributes))
    return out


def test_parts(spark):
    rng = random.Random(6)
    bits = ["<p>", "</p>", "<b lang='en'>", "</b>", "<div a=\"1 > 0\" lang=\"de\">", "</div>", "<br>", "<x/>", "text", "é", "<!-- <p> -->", "<script>var t='</p>';</script>", "<?pi?>", "<![CDATA[<b>]]>", "< p>", "<i ='1' \U00010000='2' z='3' a='4'>", "</i>", "\n", "<Li>", "</lI>"]
    rows = [None, "", "no tags", "<", "<p", "<div>" * 300 + "</div>" * 300, "<p>" + "x" * 200_000 + "</p>", "<b>a</b>" * 700] + ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string").select("id", "t", markup.parts(F.col("t")).alias("p"))
    got = df.select("id", "p", markup.well_formed(F.col("p")).alias("w"), markup.hidden(F.col("p"), F.col("t")).alias("h")).collect()
    for r in got:
        want = plain(rows[r.id])
        assert (r.p and [tuple(x) for x in r.p]) == want, rows[r.id]
        if want:
            assert r.h == [rows[r.id][x[3] : x[3] + x[4]] for x in want if x[1] in ("comment", "cdata", "instruction", "raw")]
    by = {r.id: r.w for r in got}
    assert by[0] is None and by[1] and by[6] and by[7] and not by[5]
    # U+10000 is written as two surrogates, which sort before U+E000
    assert [x.attributes for x in spark.createDataFrame([(bits[15],)], "t string").select(F.inline(markup.parts(F.col("t")))).collect()] == ['a="4" z="3" \U00010000="2" ="1"']
