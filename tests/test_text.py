import pytest
from pyspark.sql import functions as F

from lodeweave.functions import cleaning as C
from lodeweave.functions import normalizers as N
from lodeweave.functions import similarity as S
from lodeweave.operators import chunking


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "text, f, want",
    [
        ("OpenSideGuardAlarmEvent", N.evaluation, "open side guard alarm event"), ("THERMOMAGNET-SWITCHES. END", N.evaluation, "thermomagnet switches end"), (None, N.evaluation, ""), ("Défaut_de—phase", N.domain, "défaut de phase"),
        ("Défaut (n° 3)", N.consolidation, "defaut n 3"), (" A  b! ", N.grouping, "a b"), ("semantic_role:alarm", N.compatibility, "semanticrolealarm"), ("nan", N.ontology_label, ""), ("PartOf/x", N.ontology_label, "part of x"),
        ("caused by", N.relation, "CAUSES"), ("--", N.slug, "unknown"), ("A & B", N.iri_part, "A_and_B"), (' "Quoted  Text" ', N.docred, "quoted text"), (" L’eau. ", N.profile_key, "l'eau"), ("Page 12 of 40", N.line_key, "page # of #"),
        ("a\x00b­c", lambda c: C.strip_soft_hyphens(C.strip_controls(c)), "abc"), ("x<div>y</div><b>z</b>", C.strip_html, "xz"), ("$\\alpha$ is", C.strip_latex, "is"), ("# H\n**b** [t](u)", C.strip_markdown, "H\nb t"),
        ("dÃ©faut", C.repair_encoding, "défaut"), ("Ã€ — x", C.repair_encoding, "Ã€ — x"), ("ManualInstruction", C.split_fused, "Manual Instruction"), ("ma-\nchine", C.join_broken, "machine"), ("a l a r m now?", C.join_spaced_letters, "alarmnow?"),
        ("3 / 10\ntext\n- 5 -\nPage 12\n\n42", C.drop_headers, "text\n"), ("INDEX\na .... 3 .... 4\nkeep", C.drop_contents, "keep"), ("0il and 1ine and corner", C.fix_confusions, "Oil and line and comer"), ("a\n\na\nb\na", C.dedupe_adjacent, "a\n\nb\na"),
        ("---- 12 ----\n??\nwords", C.drop_garbage, "??\nwords"), ("a  b \n\n\n\nc", C.fix_whitespace, "a b\n\nc"), ("iinnppuutt MMaaiinn", lambda c: C.repair_glyphs(c), "input Main"), ("", C.clean, ""), (None, C.clean, None),
        ("Le filtre est dans la machine et les pompes", C.language, "fr"), ("0 1 2", C.language, None), ("api_key = abcdefghijklmnop", C.has_secret, True), (None, C.has_secret, False),
    ],
)
def test_columns(spark, text, f, want):
    got = one(spark, text, f)
    assert (got.rstrip("\n") if isinstance(got, str) and isinstance(want, str) else got) == (want.rstrip("\n") if isinstance(want, str) else want)


def test_long_text(spark):
    t = "word and number 12. " * 20_000
    assert one(spark, t, C.clean).startswith("word and number")
    df = spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "ab")], "doc_id int, text string")
    parts = chunking.fixed_chunks(df, size=1000, overlap=100).orderBy("doc_id", "start_char").collect()
    mine = [r for r in parts if r["doc_id"] == 1]
    assert mine[0]["chunk"] == t[:1000] and mine[-1]["end_char"] == len(t) and all(b["start_char"] == a["start_char"] + 900 for a, b in zip(mine, mine[1:])) and {r["doc_id"] for r in parts} == {1, 4}
    with pytest.raises(ValueError):
        chunking.fixed_chunks(df, size=10, overlap=10)
    assert chunking.token_chunks(df, size=50, overlap=10).where("doc_id = 4").count() == 1


def test_similarity():
    assert S.ratio("abc", "abc") == 100.0 and S.ratio("", "a") == 0.0 and round(S.ratio("kitten", "sitting"), 2) == 61.54
    assert S.token_set_ratio("side guard open", "open guard") == 100.0 and S.token_sort_ratio("a b", "b a") == 100.0
    assert S.partial_ratio("guard", "the side guard is open") == 100.0 and S.strict("a", "a") == 100.0
    assert S.bleu("the cat sat", "the cat sat") > 0.5 and S.bleu("a", "") == 0.0 and S.consolidated("", "") == 1.0
    assert S.blended("open guard", "open guard alarm") >= 0.66


def test_native_similarity_matches_python(spark):
    pairs = [("open side guard", "side guard"), ("a", "b"), ("", "x"), ("valve", "valve")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.jaccard(F.col("a"), F.col("b")).alias("j"), S.trigram_jaccard(F.col("a"), F.col("b")).alias("t"))
    for r in df.collect():
        x, y = set(r["a"].split()), set(r["b"].split())
        assert r["j"] == (len(x & y) / len(x | y) if x and y else 0.0)
        g = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))} if s else set()
        assert r["t"] == (len(g(r["a"]) & g(r["b"])) / len(g(r["a"]) | g(r["b"])) if g(r["a"]) and g(r["b"]) else 0.0)
