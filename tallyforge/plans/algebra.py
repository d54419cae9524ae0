"""Queries that solve, simplify and calculate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import calculator, monomials, polynomials
from tallyforge.functions import text as T
from tallyforge.operators.extract import answers, verify_key
from tallyforge.sources.adapters import CARDS, cards, table


def c01(s, d):
    messy = F.concat(F.col("number").cast("string"), F.lit(") Solve for x:  "), F.translate("question", "x+", "X+"), F.lit("  x = ____"))
    return cards(s, d).select("deck_id", "card_id", T.clean_equation(messy).alias("clean"))


def c04(s, d):
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).where("b > 0").distinct().select("a", "b", T.gcd(F.col("a"), F.col("b")).alias("g"), T.fraction_text(F.col("a"), F.col("b")).alias("fraction"))


def c06(s, d):
    return answers(cards(s, d).select("deck_id", "question")).groupBy(F.col("auto").alias("answer")).agg(F.count("*").alias("n"), F.countDistinct("deck_id").alias("decks"))


def c06_native(s, d):
    n = F.col("c") - F.col("b")
    return cards(s, d).select("deck_id", "card_id", F.concat(F.lit("x = "), T.fraction_text(n, F.col("a"))).alias("answer"))


def _once(rows, made, name, column="question"):
    """A text expression of much work, for each distinct text and joined back; the distinct side has each key once, so a hot text can be split (spark.sql.adaptive.skewJoin)."""
    done = rows.select(column).distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn(name, made(column))
    return rows.join(done, column, "left")


def _solved(rows):
    return _once(rows, polynomials.solve, "s")


def c02(s, d):
    """Two equations in a part, parted by commas, lines, 'and', or only by the white space behind a right side."""
    b, c = F.col("b").cast("string"), F.col("c").cast("string")
    gap = F.get(F.array(*[F.lit(g) for g in (" ", ", ", "; ", "\n", " and ", ",")]), (F.col("part") % 6).cast("int"))
    rows = cards(s, d).select("card_id", F.concat(F.lit("x + y = "), b, gap, F.lit("x - y = "), c).alias("question"))
    return _solved(rows).select("card_id", F.size(polynomials.equations(F.col("question"))).cast("long").alias("parts"), "s.answer")


def c07(s, d):
    p, q = F.col("a"), F.col("c") % 10
    rows = cards(s, d).select("card_id", F.concat(F.lit("x^2 + "), (-(p + q)).cast("string"), F.lit("x + "), (p * q).cast("string"), F.lit(" = 0")).alias("question"))
    return _solved(rows).select("card_id", "s.answer", "s.kind")


def c07_irrational(s, d):
    rows = cards(s, d).select(F.concat(F.lit("x^2 + "), F.col("a").cast("string"), F.lit("x = "), (F.col("c") + 1).cast("string")).alias("question")).distinct()
    return _solved(rows).select("question", F.col("s.answer").alias("answer"), F.col("s.kind").alias("kind"), F.round(F.get("s.roots", F.lit(0)), 6).alias("first_root"))


def c09(s, d):
    rows = cards(s, d).select("card_id", F.concat(F.lit("x + y = "), F.col("b").cast("string"), F.lit(", x - y = "), F.col("c").cast("string")).alias("question"))
    return _solved(rows).select("card_id", "s.answer")


def c10(s, d):
    a = F.col("a").cast("string")
    same = F.concat(a, F.lit("x + "), F.col("b").cast("string"), F.lit(" = "), a, F.lit("x + "), (F.col("c") % 50).cast("string"))
    return _solved(cards(s, d).select("card_id", same.alias("question"))).select("card_id", "s.answer")


def c11(s, d):
    b = F.col("b").cast("string")
    odd = F.when(F.col("part") % 5 == 0, F.concat(F.lit("x + y = "), b)).when(F.col("part") % 5 == 1, F.concat(F.lit("x^3 = "), b)).when(F.col("part") % 5 == 2, F.concat(b, F.lit(" = "), b)).when(F.col("part") % 5 == 3, F.concat(F.lit("x - 1 = "), b)).otherwise(F.concat(b, F.lit("x + 1")))
    return _solved(cards(s, d).select("card_id", odd.alias("question"))).select("card_id", "s.answer")


def c12(s, d):
    return _once(cards(s, d).select("card_id", "question"), polynomials.steps, "steps").select("card_id", F.array_join("steps", " | ").alias("working"))


def _monomials(s, d):
    p, q = F.col("p_partkey") % 5 + 1, F.col("p_size") % 7 + 1
    return table(s, d, "part").select("p_partkey", "p_size", p.alias("p"), q.alias("q"))


def c24(s, d):
    text = F.concat(F.col("p_size").cast("string"), F.lit("x^"), F.col("p").cast("string"), F.lit(" * y * x^"), F.col("q").cast("string"))
    return _once(_monomials(s, d).withColumn("question", text), monomials.simplify, "s").select("p_partkey", "question", F.col("s.form").alias("answer"))


def c22(s, d):
    text = F.concat(F.lit("x^"), F.col("p").cast("string"), F.lit(" / x^"), F.col("q").cast("string"))
    return _once(_monomials(s, d).withColumn("question", text), monomials.canonical, "c").select("p_partkey", F.col("c.form").alias("answer"))


def c25(s, d):
    text = F.concat(F.col("p_size").cast("string"), F.lit(" × x ^ "), F.col("p").cast("string"), F.lit("+y−"), F.col("q").cast("string"))
    return _monomials(s, d).select("p_partkey", T.tidy_expression(text).alias("tidy"))


def c26(s, d):
    deck = cards(s, d)
    q = F.when(F.col("part") % 2 == 0, F.col("question")).when(F.col("part") % 3 == 0, F.concat(F.lit("x^"), F.col("a").cast("string"), F.lit(" * x"))).otherwise("words only")
    return answers(deck.select("card_id", q.alias("question"))).select("card_id", F.col("auto").alias("answer"), F.col("auto_kind").alias("kind"))


def c27(s, d):
    """The key holds another writing of the same product, of an equation's solution or of a word; it is wrong for one part in three, and each side lacks some parts."""
    rows = _monomials(s, d)
    n, form = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    off = F.when(F.col("p_partkey") % 3 == 0, F.col("p") + 1).otherwise(F.col("p")).cast("string")
    mine = F.when(form == 0, F.concat(F.lit("x + "), n, F.lit(" = "), (F.col("p_size") + F.col("p")).cast("string"))).when(form == 1, F.concat(F.lit("part  no "), F.col("p").cast("string"), F.lit("?"))).otherwise(F.concat(F.lit("("), n, F.lit("y)x^"), F.col("p").cast("string")))
    key = F.when(form == 0, F.concat(F.lit("2x = "), (off.cast("bigint") * 2).cast("string"))).when(form == 1, F.concat(F.lit("partno"), off, F.lit(" ?"))).otherwise(F.concat(F.lit("x^"), off, F.lit(" * y * "), n))
    left = rows.where("p_partkey % 11 <> 0").select("p_partkey", "q", mine.alias("expression"))
    right = rows.where("p_partkey % 13 <> 0").select("p_partkey", "q", key.alias("expression"))
    return verify_key(left, right, ["p_partkey", "q"]).groupBy("q", "verdict").agg(F.count("*").alias("n"))


def c31(s, d):
    a, b, c = (F.col(x).cast("string") for x in "abc")
    text = F.concat(F.lit("("), b, F.lit(" + "), c, F.lit(") / "), a, F.lit(" - 2^"), a, F.lit(" * 3"))
    return _once(cards(s, d).select("card_id", text.alias("question")), calculator.calculate, "result").select("card_id", "result")


def c30(s, d):
    """Signs of several forms: times, division, raised digits, roots, thousands, pi, and what is no calculation."""
    a, b, c = (F.col(x).cast("string") for x in "abc")
    forms = [
        F.concat(b, F.lit(" × "), c, F.lit(" ÷ "), a), F.concat(b, F.lit("²"), F.lit(" − √"), (F.col("a") * F.col("a")).cast("string")), F.concat(a, F.lit(",000 · "), b), F.concat(F.lit("√("), b, F.lit("×"), b, F.lit(") + 2π − π·2")),
        F.concat(b, F.lit(" + ∞")), F.concat(b, F.lit(","), c, F.lit("00 –")), F.concat(a, F.lit("⁻¹ × "), a), F.concat(F.lit("2^"), a, F.lit("^-1 % (1 + 1)")),
    ]
    text = F.get(F.array(*forms), (F.col("part") % len(forms)).cast("int"))
    return _once(cards(s, d).select("card_id", text.alias("question")), calculator.calculate, "result").select("card_id", "result")


def c32(s, d):
    b = F.col("b").cast("double")
    return cards(s, d).select("b").distinct().select(
        "b", F.round(F.sqrt(b), 6).alias("root"), F.round(F.cbrt(b), 6).alias("cube_root"), F.round(F.ln(b), 6).alias("ln"), F.round(F.log10(b), 6).alias("log10"), F.round(F.sin(F.radians(b)), 6).alias("sine"),
        F.round(F.degrees(F.atan(b)), 6).alias("arc_tangent"), F.round(F.pi() * b, 6).alias("times_pi"), F.round(F.e() * b, 6).alias("times_e"),
    )


def c35(s, d):
    text = F.when(F.col("part") % 3 == 0, F.concat(F.lit("(x + "), F.col("b").cast("string"), F.lit(")/"), F.col("c").cast("string"))).when(F.col("part") % 3 == 1, F.lit("say it in words")).otherwise(F.lit("(x)"))
    slash = T.top_slash(text)
    return cards(s, d).select("card_id", T.looks_mathy(text).alias("mathy"), slash["top"].alias("top"), slash["bottom"].alias("bottom"), T.outer_parens_off(text).alias("bare"))


QUERIES = {
    "c01_clean_equation": c01, "c02_equation_split": c02, "c04_gcd_fraction": c04, "c06_linear_solve": c06, "c06_native_linear": c06_native, "c07_quadratic_solve": c07, "c07_c08_irrational_roots": c07_irrational, "c09_system_solve": c09, "c10_degenerate": c10,
    "c11_rejected": c11, "c12_steps": c12, "c20_c24_simplify": c24, "c22_c23_canonical": c22, "c25_tidy": c25, "c26_auto_answer": c26, "c27_key_verification": c27, "c30_symbols": c30, "c31_c34_calculate": c31, "c32_c33_functions": c32, "c35_math_text": c35,
}

MONO = "m AS (SELECT p_partkey, p_size, p_partkey % 5 + 1 AS p, p_size % 7 + 1 AS q FROM part)"
HALF = "CASE WHEN ({0}) % 2 = 0 THEN CAST(({0}) // 2 AS VARCHAR) ELSE CAST({0} AS VARCHAR) || '/2' END"

ORACLE_SQL = {
    "c01_clean_equation": f"WITH {CARDS} SELECT deck_id, card_id, question AS clean FROM cards",
    "c04_gcd_fraction": """SELECT a, b, gcd(a, b) AS g, CASE WHEN a % b = 0 THEN CAST(a // b AS VARCHAR) ELSE CAST(a // gcd(a, b) AS VARCHAR) || '/' || CAST(b // gcd(a, b) AS VARCHAR) END AS fraction
      FROM (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_suppkey > 0)""",
    "c06_linear_solve": f"WITH {CARDS} SELECT solved AS answer, count(*) AS n, count(DISTINCT deck_id) AS decks FROM cards GROUP BY solved",
    "c06_native_linear": f"WITH {CARDS} SELECT deck_id, card_id, solved AS answer FROM cards",
    "c07_quadratic_solve": f"""WITH {CARDS} SELECT card_id, CASE WHEN a = c % 10 THEN 'x = ' || CAST(a AS VARCHAR)
      ELSE 'x = ' || CAST(greatest(a, c % 10) AS VARCHAR) || ' or x = ' || CAST(least(a, c % 10) AS VARCHAR) END AS answer, 'quadratic' AS kind FROM cards""",
    "c09_system_solve": f"WITH {CARDS} SELECT card_id, 'x = ' || {HALF.format('b + c')} || ',  y = ' || {HALF.format('b - c')} AS answer FROM cards",
    "c10_degenerate": f"WITH {CARDS} SELECT card_id, CASE WHEN b = c % 50 THEN 'all real numbers' ELSE 'no solution' END AS answer FROM cards",
    "c11_rejected": f"WITH {CARDS} SELECT card_id, CASE WHEN part % 5 = 3 THEN 'x = ' || CAST(b + 1 AS VARCHAR) END AS answer FROM cards",
    "c02_equation_split": f"WITH {CARDS} SELECT card_id, CAST(2 AS BIGINT) AS parts, 'x = ' || {HALF.format('b + c')} || ',  y = ' || {HALF.format('b - c')} AS answer FROM cards",
    "c12_steps": f"""WITH {CARDS} SELECT card_id, question || CASE WHEN a = 1 THEN '' ELSE ' | ' || CAST(a AS VARCHAR) || 'x = ' || CAST(c - b AS VARCHAR) || ' | x = ' || CAST(c - b AS VARCHAR) || ' / ' || CAST(a AS VARCHAR) END
      || ' | ' || solved AS working FROM cards""",
    "c20_c24_simplify": f"""WITH {MONO} SELECT p_partkey, CAST(p_size AS VARCHAR) || 'x^' || CAST(p AS VARCHAR) || ' * y * x^' || CAST(q AS VARCHAR) AS question,
      CASE WHEN p_size = 1 THEN '' ELSE CAST(p_size AS VARCHAR) END || 'x^' || CAST(p + q AS VARCHAR) || 'y' AS answer FROM m""",
    "c22_c23_canonical": f"""WITH {MONO} SELECT p_partkey, CASE WHEN p = q THEN '1' WHEN p = q + 1 THEN 'x' WHEN p > q THEN 'x^' || CAST(p - q AS VARCHAR)
      WHEN q = p + 1 THEN '1/x' ELSE '1/x^' || CAST(q - p AS VARCHAR) END AS answer FROM m""",
    "c25_tidy": f"WITH {MONO} SELECT p_partkey, CAST(p_size AS VARCHAR) || '*x^' || CAST(p AS VARCHAR) || ' + y - ' || CAST(q AS VARCHAR) AS tidy FROM m",
    "c26_auto_answer": f"""WITH {CARDS} SELECT card_id, CASE WHEN part % 2 = 0 THEN solved WHEN part % 3 = 0 THEN 'x^' || CAST(a + 1 AS VARCHAR) END AS answer,
      CASE WHEN part % 2 = 0 THEN 'linear' WHEN part % 3 = 0 THEN 'monomial' END AS kind FROM cards""",
    "c27_key_verification": f"""WITH {MONO} SELECT q, CASE WHEN p_partkey % 13 = 0 THEN 'no key' WHEN p_partkey % 11 = 0 THEN 'no answer' WHEN p_partkey % 3 = 0 THEN 'differ' ELSE 'match' END AS verdict, count(*) AS n
      FROM m WHERE p_partkey % 143 <> 0 GROUP BY ALL""",
    "c30_symbols": f"""WITH {CARDS}, v AS (SELECT card_id, part % 8 AS k, CASE part % 8 WHEN 0 THEN b * c / CAST(a AS DOUBLE) WHEN 1 THEN b * b - a WHEN 2 THEN a * 1000 * b WHEN 3 THEN b WHEN 6 THEN 1 WHEN 7 THEN fmod(pow(2, 1.0 / a), 2) END AS x FROM cards)
      SELECT card_id, CASE WHEN k = 4 THEN 'undefined' WHEN k = 5 THEN NULL WHEN abs(x - round(x)) < 1e-10 THEN CAST(CAST(round(x) AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.8f', x), '0'), '.') END AS result FROM v""",
    "c31_c34_calculate": f"""WITH {CARDS}, v AS (SELECT card_id, (b + c) / CAST(a AS DOUBLE) - pow(2, a) * 3 AS x FROM cards)
      SELECT card_id, CASE WHEN abs(x - round(x)) < 1e-10 THEN CAST(CAST(round(x) AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.8f', x), '0'), '.') END AS result FROM v""",
    "c32_c33_functions": f"""WITH {CARDS} SELECT b, round(sqrt(b), 6) AS root, round(cbrt(b), 6) AS cube_root, round(ln(b), 6) AS ln, round(log10(b), 6) AS log10, round(sin(radians(b)), 6) AS sine,
      round(degrees(atan(b)), 6) AS arc_tangent, round(pi() * b, 6) AS times_pi, round(exp(1) * b, 6) AS times_e FROM (SELECT DISTINCT CAST(b AS DOUBLE) AS b FROM cards)""",
    "c35_math_text": f"""WITH {CARDS}, t AS (SELECT card_id, part % 3 AS k, '(x + ' || CAST(b AS VARCHAR) || ')' AS top, CAST(c AS VARCHAR) AS bottom FROM cards)
      SELECT card_id, k = 0 AS mathy, CASE WHEN k = 0 THEN top END AS top, CASE WHEN k = 0 THEN bottom END AS bottom,
        CASE k WHEN 0 THEN top || '/' || bottom WHEN 1 THEN 'say it in words' ELSE 'x' END AS bare FROM t""",
}
#: The largest square that divides the discriminant, by trying all roots.
ORACLE_SQL["c07_c08_irrational_roots"] = f"""WITH {CARDS}, d AS (SELECT DISTINCT a, c + 1 AS n, a * a + 4 * (c + 1) AS disc FROM cards),
  k AS (SELECT d.a, d.n, d.disc, max(r.i) AS k FROM d, range(1, 60) AS r(i) WHERE d.disc % (r.i * r.i) = 0 GROUP BY d.a, d.n, d.disc),
  x AS (SELECT *, disc // (k * k) AS m, (-a + sqrt(disc)) / 2 AS hi, (-a - sqrt(disc)) / 2 AS lo FROM k)
  SELECT 'x^2 + ' || CAST(a AS VARCHAR) || 'x = ' || CAST(n AS VARCHAR) AS question,
    CASE WHEN m = 1 THEN 'x = ' || CAST((k - a) // 2 AS VARCHAR) || ' or x = ' || CAST(-(k + a) // 2 AS VARCHAR)
      ELSE 'x = (' || CAST(-a AS VARCHAR) || ' ± ' || CASE WHEN k = 1 THEN '' ELSE CAST(k AS VARCHAR) END || '√' || CAST(m AS VARCHAR) || ') / 2  ≈  ' || rtrim(rtrim(printf('%.3f', hi), '0'), '.') || ' or ' || rtrim(rtrim(printf('%.3f', lo), '0'), '.') END AS answer,
    CASE WHEN m = 1 THEN 'quadratic' ELSE 'radical' END AS kind, round(hi, 6) AS first_root FROM x"""
ORACLE_SQL["c32_c33_functions"] = ORACLE_SQL["c32_c33_functions"].replace("SELECT b, round(sqrt", "SELECT CAST(b AS BIGINT) AS b, round(sqrt")
