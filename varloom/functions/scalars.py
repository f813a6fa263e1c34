"""Column expressions shared by the operators (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTOSOMES = [str(i) for i in range(1, 23)]
CHROMOSOMES = AUTOSOMES + ["X", "Y", "MT"]


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- chromosomes and identifiers -------------------------------------------


def chr_order(c: Column | str) -> Column:
    """1..22, X=23, Y=24, MT=25; anything else null."""
    c = as_col(c)
    return (
        F.when(c == "X", 23).when(c == "Y", 24).when(c == "MT", 25).otherwise(c.try_cast("int"))
    )


def snpid(chrom="Chromosome", pos="Position", nea="NEA", ea="EA") -> Column:
    """chr:pos:NEA:EA, null when any part is null."""
    parts = [as_col(x) for x in (chrom, pos, nea, ea)]
    sep = F.lit(":")
    return F.concat(parts[0], sep, parts[1].cast("string"), sep, parts[2], sep, parts[3])


def snpid_blank(chrom="Chromosome", pos="Position", nea="NEA", ea="EA") -> Column:
    """Same id, but missing alleles become empty and missing coordinates give null."""
    empty = F.lit("")
    return snpid(chrom, pos, F.coalesce(as_col(nea), empty), F.coalesce(as_col(ea), empty))


def ukb_id(c: Column | str) -> Column:
    """`a_b_c_d` or `a:b:c:d` to `a:b_c_d`; ids with fewer than four parts stay."""
    c = as_col(c)
    p = F.split(c, "_|:")
    return F.when(
        F.size(p) >= 4,
        F.concat(p[0], F.lit(":"), p[1], F.lit("_"), p[2], F.lit("_"), p[3]),
    ).otherwise(c)


def first_id(*cols: str) -> Column:
    """First id that is not null or blank."""
    return F.coalesce(*[F.nullif(F.trim(as_col(c)), F.lit("")) for c in cols])


def thousands_position(chrom: Column, pos: Column) -> Column:
    """`Chr1:12,345`."""
    return F.concat(F.lit("Chr"), chrom, F.lit(":"), F.format_number(pos.cast("long"), 0))


def cell_name(c: Column | str) -> Column:
    """Cell type without its single-digit cluster suffixes."""
    c = as_col(c)
    return F.when(c.rlike(r".+_\d+"), F.regexp_replace(c, r"_\d", "")).otherwise(c)


def cell_cluster(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(
        c.rlike(r".+_\d+"), F.concat_ws("_", F.regexp_extract_all(c, F.lit(r"_(\d)"), F.lit(1)))
    )


# Patterns of library names: number and letter after the species, letter before the
# donors, donors, the tail of letter and donors, the species part.
LIBRARY_NUMBER = r"_Hu_(\d+)[^_]*"
LIBRARY_LETTER_AFTER = r"_Hu_\d+([^_]*)"
LIBRARY_LETTER = r"_([A-Z])_\d+D$"
LIBRARY_DONORS = r"(\d+D)$"
LIBRARY_TAIL = r"(_[A-Z])*_\d+D$"
LIBRARY_SPECIES = r"_Hu_[^_]+"


def library_id(c: Column | str, study: str, label: str) -> Column:
    """Library name with its sorting batch moved behind the cell type.

    With study `S` and label `S-lab`, `SB_Hu_3_CD4_C_10D` becomes
    `S-lab-B_Hu_CD4_3C_10D`. The batch letter may also follow the number (`_Hu_3C_`); A
    stands for a single batch.
    """
    c = as_col(c)
    blank = F.lit("")
    number = F.regexp_extract(c, LIBRARY_NUMBER, 1)
    letter = F.coalesce(
        F.nullif(F.regexp_extract(c, LIBRARY_LETTER, 1), blank),
        F.nullif(F.regexp_extract(c, LIBRARY_LETTER_AFTER, 1), blank),
        F.lit("A"),
    )
    donors = F.regexp_extract(c, LIBRARY_DONORS, 1)
    core = F.regexp_replace(F.regexp_replace(c, LIBRARY_TAIL, ""), LIBRARY_SPECIES, "_Hu")
    run = F.nullif(F.regexp_extract(c, f"^{study}([^_]+)", 1), blank)
    core = F.regexp_replace(core, f"^{study}[^_]*", "")
    head = F.concat(F.lit(f"{label}-"), F.coalesce(run, F.lit("A")))
    return F.concat(head, core, F.lit("_"), number, letter, F.lit("_"), donors)


def disease_of_file(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"_\d+$", "")


def category_of_file(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(as_col(c), r"_(\d+)$", 1), F.lit("")).cast("int")


# --- alleles ----------------------------------------------------------------

# IUPAC codes and their complements; other characters are deleted.
IUPAC = "ACTGNactgnYRWSKMDVHBXyrwskmdvhbx"
IUPAC_COMPLEMENT = "TGACNtgacnRYWSMKHBDVXrywsmkhbdvx"

# Match codes are 0 missing, 1 REF, 2 ALT, 3 complement of REF,
# 4 complement of ALT, 5 none; keys are "<NEA code>-<EA code>".
NOTE_OF_CODES = {
    "1-2": "Found",
    "2-1": "Flip",
    "3-4": "Complement",
    "1-0": "Fill",
    "0-2": "Fill",
    "4-3": "Flip-Complement",
    "0-1": "Flip-Fill",
    "2-0": "Flip-Fill",
    "3-0": "Complement-Fill",
    "0-4": "Complement-Fill",
    "0-3": "Flip-Complement-Fill",
    "4-0": "Flip-Complement-Fill",
}
NOTE_ORDER = [
    "Found",
    "Flip",
    "Complement",
    "Fill",
    "Flip-Complement",
    "Flip-Fill",
    "Complement-Fill",
    "Flip-Complement-Fill",
    "Not Found",
]
FLIP_NOTES = ["Flip", "Flip-Complement", "Flip-Fill", "Flip-Complement-Fill"]


def complement(c: Column | str) -> Column:
    kept = F.regexp_replace(as_col(c), f"[^{IUPAC}]", "")
    return F.translate(kept, IUPAC, IUPAC_COMPLEMENT)


def allele_code(target: Column, ref: Column, alt: Column) -> Column:
    comp = complement(target)
    return (
        F.when(target.isNull(), "0")
        .when(target == ref, "1")
        .when(target == alt, "2")
        .when(comp == ref, "3")
        .when(comp == alt, "4")
        .otherwise("5")
    )


def allele_codes(nea: Column, ea: Column, ref="REF", alt="ALT") -> Column:
    ref, alt = as_col(ref), as_col(alt)
    return F.concat(allele_code(nea, ref, alt), F.lit("-"), allele_code(ea, ref, alt))


def _lookup(table: dict[str, str | int], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def note_of(codes: Column) -> Column:
    return F.coalesce(_lookup(NOTE_OF_CODES, codes), F.lit("Not Found"))


def note_rank(note: Column | str) -> Column:
    return _lookup({n: i for i, n in enumerate(NOTE_ORDER)}, as_col(note))


def rank_of_codes(codes: Column) -> Column:
    """Rank of the note a code pair stands for."""
    ranks = {k: NOTE_ORDER.index(n) for k, n in NOTE_OF_CODES.items()}
    return F.coalesce(_lookup(ranks, codes), F.lit(len(NOTE_ORDER) - 1))


def strand_ambiguous(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin("AT", "TA", "CG", "GC")


def risk_alleles(sign: Column, nea="NEA", ea="EA") -> tuple[Column, Column]:
    """(risk, non-risk): EA raises risk unless the effect is negative or unknown."""
    up = F.coalesce(sign >= 0, F.lit(False))
    nea, ea = as_col(nea), as_col(ea)
    return F.when(up, ea).otherwise(nea), F.when(up, nea).otherwise(ea)


# --- normal distribution ----------------------------------------------------
# Spark has no normal quantile or erf. The rational approximations below are
# published ones, written as SQL text so that Catalyst compiles them.

# Coefficients of algorithm AS 241 (Wichura 1988), constant first.
AS241 = {
    "a": [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
          1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
          3.3430575583588128105e4, 2.5090809287301226727e3],
    "b": [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
          2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
          5.2264952788528545610e3],
    "c": [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
          3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
          2.27238449892691845833e-2, 7.74545014278341407640e-4],
    "d": [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
          1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
          1.05075007164441684324e-9],
    "e": [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
          2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
          2.71155556874348757815e-5, 2.01033439929228813265e-7],
    "f": [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
          7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
          2.04426310338993978564e-15],
}

# Coefficients of the rational erf/erfc approximations of Cody
# (1969), constant first; "pos"/"qos" are in 1/x**2.
CODY = {
    "erf_p": [3.20937758913846947e3, 3.77485237685302021e2, 1.13864154151050156e2,
              3.16112374387056560e0, 1.85777706184603153e-1],
    "erf_q": [2.84423683343917062e3, 1.28261652607737228e3, 2.44024637934444173e2,
              2.36012909523441209e1, 1.0],
    "mid_p": [1.23033935479799725e3, 2.05107837782607147e3, 1.71204761263407058e3,
              8.81952221241769090e2, 2.98635138197400131e2, 6.61191906371416295e1,
              8.88314979438837594e0, 5.64188496988670089e-1, 2.15311535474403846e-8],
    "mid_q": [1.23033935480374942e3, 3.43936767414372164e3, 4.36261909014324716e3,
              3.29079923573345963e3, 1.62138957456669019e3, 5.37181101862009858e2,
              1.17693950891312499e2, 1.57449261107098347e1, 1.0],
    "far_p": [6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1,
              3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2],
    "far_q": [2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1,
              1.87295284992346725e0, 2.56852019228982242e0, 1.0],
}
INV_SQRT_PI = 0.5641895835477563


def _horner(coefs: list[float], x: str) -> str:
    out = f"{coefs[-1]!r}D"
    for c in reversed(coefs[:-1]):
        out = f"({c!r}D + ({x}) * {out})"
    return out


def _ratio(num: list[float], den: list[float], x: str) -> str:
    return f"({_horner(num, x)} / {_horner(den, x)})"


def upper_quantile_sql(p: str) -> str:
    """SQL text of the positive z with upper-tail probability p, 0 < p <= 0.5.

    Evaluated on the tail, so p far below 1e-16 keeps a finite z.
    """
    q = f"(0.5D - ({p}))"
    centre = f"{q} * {_ratio(AS241['a'], AS241['b'], f'(0.180625D - {q} * {q})')}"
    r = f"sqrt(-ln({p}))"
    near = _ratio(AS241["c"], AS241["d"], f"({r} - 1.6D)")
    far = _ratio(AS241["e"], AS241["f"], f"({r} - 5.0D)")
    return (
        f"(CASE WHEN {q} <= 0.425D THEN {centre} WHEN {r} <= 5.0D THEN {near} ELSE {far} END)"
    )


def erfc_sql(x: str) -> str:
    """SQL text of erfc(x) for x >= 0."""
    y = f"(({x}) * ({x}))"
    low = f"(1.0D - ({x}) * {_ratio(CODY['erf_p'], CODY['erf_q'], y)})"
    mid = f"(exp(-{y}) * {_ratio(CODY['mid_p'], CODY['mid_q'], x)})"
    inv = f"(1.0D / {y})"
    far = (
        f"(exp(-{y}) / ({x}) * ({INV_SQRT_PI}D - {inv} * "
        f"{_ratio(CODY['far_p'], CODY['far_q'], inv)}))"
    )
    return f"(CASE WHEN ({x}) <= 0.46875D THEN {low} WHEN ({x}) <= 4.0D THEN {mid} ELSE {far} END)"


def z_from_p(p: str, sign: str, legacy_sign: bool = False) -> Column:
    """sign * quantile(1 - p/2); p = 0 is read as 1e-300."""
    safe = f"(CASE WHEN {p} = 0 THEN 1e-300D ELSE {p} END)"
    z = f"(signum({sign}) * {upper_quantile_sql(f'({safe} / 2)')})"
    return F.expr(f"-{z}" if legacy_sign else z)


def p_from_z(z: str) -> Column:
    """Two-sided p-value of a z-score."""
    return F.expr(erfc_sql(f"(abs({z}) / 1.4142135623730951D)"))


# --- effect statistics ------------------------------------------------------


def beta_from_or(odds: Column | str) -> Column:
    return F.ln(as_col(odds))


def z_from_beta_se(beta="BETA", se="SE") -> Column:
    return F.try_divide(as_col(beta), as_col(se))


def se_from_beta_z(beta="BETA", z="Z") -> Column:
    return F.abs(F.try_divide(as_col(beta), as_col(z)))


def se_from_n(n: Column | float) -> Column:
    n = n if isinstance(n, Column) else F.lit(float(n))
    return F.lit(1.0) / F.sqrt(n)


def se_from_n_maf(n: Column | float, maf="MAF") -> Column:
    n = n if isinstance(n, Column) else F.lit(float(n))
    maf = as_col(maf)
    return F.lit(1.0) / F.sqrt(F.lit(2.0) * n * maf * (F.lit(1.0) - maf))


def neg_log10(p: Column | str, cap: float | None = None) -> Column:
    """-log10(p), at most `cap`; with a cap, p = 0 reaches it. A null stays null."""
    p = as_col(p)
    v = -F.log10(p)
    return v if cap is None else F.when(p == 0, F.lit(float(cap))).otherwise(clamp(v, None, cap))


def clamp(v: Column | str, lo: float | None, hi: float | None) -> Column:
    """v within its limits. A null stays null, which greatest and least alone would skip."""
    v = as_col(v)
    out = v if lo is None else F.greatest(v, F.lit(float(lo)))
    out = out if hi is None else F.least(out, F.lit(float(hi)))
    return F.when(v.isNotNull(), out)


def logit(p: Column | str, adjust: Column | None = None) -> Column:
    """Log odds. Where `adjust` holds, shares are first mapped linearly into 0.025 to 0.975.

    Without `adjust` only a share of exactly 0 or 1 is mapped.
    """
    p = as_col(p)
    adjust = p.isin(0.0, 1.0) if adjust is None else adjust
    p = F.when(adjust, F.lit(0.5) + (p - 0.5) * 0.95).otherwise(p)
    return F.ln(p / (F.lit(1.0) - p))


def midpoint(start: Column | str, end: Column | str) -> Column:
    return F.floor((as_col(start) + as_col(end)) / 2)


def no_neg_zero(c: Column) -> Column:
    return F.when(c == 0, F.lit(0.0)).otherwise(c)
