"""Normal distribution as SQL text that Spark and other engines evaluate alike, and as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Hart/West double-precision rational for the normal integral.
HART_NUM = ("3.52624965998911e-02", "7.00383064443688e-01", "6.37396220353165e0", "3.3912866078383e1", "1.12079291497871e2", "2.21213596169931e2", "2.20206867912376e2")
HART_DEN = ("8.83883476483184e-02", "1.75566716318264e0", "1.6064177579207e1", "8.67807322029461e1", "2.96564248779674e2", "6.37333633378831e2", "7.93826512519948e2", "4.40413735824752e2")
# Coefficients of algorithm AS 241 for the normal quantile.
AS241_A = ("2.5090809287301226727e3", "3.3430575583588128105e4", "6.7265770927008700853e4", "4.5921953931549871457e4", "1.3731693765509461125e4", "1.9715909503065514427e3", "1.3314166789178437745e2", "3.3871328727963666080e0")
AS241_B = ("5.2264952788528545610e3", "2.8729085735721942674e4", "3.9307895800092710610e4", "2.1213794301586595867e4", "5.3941960214247511077e3", "6.8718700749205790830e2", "4.2313330701600911252e1", "1.0e0")
AS241_C = ("7.74545014278341407640e-4", "2.27238449892691845833e-2", "2.41780725177450611770e-1", "1.27045825245236838258e0", "3.64784832476320460504e0", "5.76949722146069140550e0", "4.63033784615654529590e0", "1.42343711074968357734e0")
AS241_D = ("1.05075007164441684324e-9", "5.47593808499534494600e-4", "1.51986665636164571966e-2", "1.48103976427480074590e-1", "6.89767334985100004550e-1", "1.67638483018380384940e0", "2.05319162663775882187e0", "1.0e0")
AS241_E = ("2.01033439929228813265e-7", "2.71155556874348757815e-5", "1.24266094738807843860e-3", "2.65321895265761230930e-2", "2.96560571828504891230e-1", "1.78482653991729133580e0", "5.46378491116411436990e0", "6.65790464350110377720e0")
AS241_F = ("2.04426310338993978564e-15", "1.42151175831644588870e-7", "1.84631831751005468180e-5", "7.86869131145613259100e-4", "1.48753612908506148525e-2", "1.36929880922735805310e-1", "5.99832206555887937690e-1", "1.0e0")


def horner(coefficients: tuple[str, ...], x: str) -> str:
    out = coefficients[0]
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c})"
    return out


def phi_sql(x: str) -> str:
    """Normal distribution function of the SQL expression x."""
    x = f"({x})"
    a = f"abs({x})"
    near = f"exp(-{x} * {x} / 2e0) * {horner(HART_NUM, a)} / {horner(HART_DEN, a)}"
    far = f"exp(-{x} * {x} / 2e0) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 6.5e-1))))) / 2.506628274631e0"
    tail = f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0e0 THEN 1e0 - {tail} ELSE {tail} END)"


def phi_inv_sql(p: str) -> str:
    """Normal quantile of the SQL expression p; null outside (0, 1)."""
    p = f"({p})"
    q = f"({p} - 5e-1)"
    r0 = f"(1.80625e-1 - {q} * {q})"
    t = f"sqrt(-ln(CASE WHEN {q} < 0e0 THEN {p} ELSE 1e0 - {p} END))"
    sign = f"(CASE WHEN {q} < 0e0 THEN -1e0 ELSE 1e0 END)"
    r1, r2 = f"({t} - 1.6e0)", f"({t} - 5e0)"
    return (
        f"(CASE WHEN {p} IS NULL OR {p} <= 0e0 OR {p} >= 1e0 THEN NULL"
        f" WHEN abs({q}) <= 4.25e-1 THEN {q} * {horner(AS241_A, r0)} / {horner(AS241_B, r0)}"
        f" WHEN {t} <= 5e0 THEN {sign} * {horner(AS241_C, r1)} / {horner(AS241_D, r1)}"
        f" ELSE {sign} * {horner(AS241_E, r2)} / {horner(AS241_F, r2)} END)"
    )


def phi(column: str) -> Column:
    return F.expr(phi_sql(column))


def phi_inv(column: str) -> Column:
    return F.expr(phi_inv_sql(column))
