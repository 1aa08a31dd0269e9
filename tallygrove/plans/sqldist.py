"""Distribution functions as SQL text, for oracles: finite sums, series and continued fractions, unlike what the operators use."""

from __future__ import annotations


def sql_t_two_sided(t: str, df: str) -> str:
    """P(|T| >= |t|) for a whole number of degrees of freedom: the finite trigonometric sums for even and odd df."""
    cos2 = f"(({df}) / (({df}) + ({t}) * ({t})))"
    sine = f"sqrt(1 - {cos2})"
    even = f"{sine} * list_sum(list_transform(range(0, (({df}) // 2)::bigint), lambda k: exp(k * ln({cos2}) + lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1))))"
    odd = f"(atan(abs({t}) / sqrt({df})) + case when ({df}) > 1 then {sine} * list_sum(list_transform(range(0, ((({df}) - 1) // 2)::bigint), lambda k: exp((k + 0.5) * ln({cos2}) + lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)))) else 0 end) * 2 / pi()"
    return f"(1 - case when ({df})::bigint % 2 = 0 then {even} else {odd} end)"


def sql_normal_two_sided(z: str) -> str:
    """P(|Z| >= |z|): a series of positive terms up to 3, the continued fraction of the tail beyond."""
    x2 = f"(({z}) * ({z}) / 2)"
    near = f"(1 - sqrt({x2}) * exp(-{x2}) * list_sum(list_transform(range(0, 80), lambda n: exp(n * ln({x2} + 1e-300) - lgamma(n + 1.5)))))"
    return f"(case when abs({z}) < 3 then {near} else exp(-{sql_normal_nlp(z)} * ln(10)) end)"


def sql_normal_nlp(z: str) -> str:
    """-log10 P(|Z| >= |z|) from the continued fraction; for |z| of 2 or more."""
    x = f"(abs({z}) / sqrt(2))"
    tail = f"list_reduce(list_reverse(list_transform(range(1, 121), lambda k: k / 2.0)), lambda a, k: {x} + k / a, {x})"
    return f"(({x} * {x} + 0.5 * ln(pi()) + ln({tail})) / ln(10))"
