"""SQL texts that several modules of this folder use."""

#: Faults put into one episode in so many, with formulas that mean the same in both engines.
FAULTS = {
    "Episode": "CASE WHEN Episode % 89 = 0 THEN Episode - Episode % 1099511627776 ELSE Episode END",
    "DoB": "CASE WHEN Episode % 1009 = 0 THEN DoB + CAST(1 AS INT) WHEN Episode % 907 = 0 THEN NULL ELSE DoB END",
    "DoD": "CASE WHEN Episode % 53 = 0 THEN NULL WHEN Episode % 97 = 0 THEN DoD + CAST(Episode % 7 AS INT) ELSE DoD END",
    "Sex": "CASE WHEN Episode % 811 = 0 THEN NULL WHEN Episode % 701 = 0 THEN 3 - Sex ELSE Sex END",
    "EndDate": "CASE WHEN Episode % 613 = 0 THEN StartDate - CAST(1 AS INT) ELSE EndDate END",
    "StartDate": "CASE WHEN Episode % 501 = 0 THEN DATE '1930-01-01' ELSE StartDate END",
    "IndividualId": "CASE WHEN Episode % 10007 = 0 THEN NULL ELSE IndividualId END",
}


def decimal_year(d: str) -> str:
    return f"(year({d}) + (dayofyear({d}) - 1) / dayofyear(make_date(year({d}), 12, 31)))"


def nearest(x: str, digits: int) -> str:
    """The nearer neighbour with that many decimals, the even one on a tie."""
    p = float(10**digits)
    low, high = f"floor(({x}) * {p}) / {p}", f"(floor(({x}) * {p}) + 1) / {p}"
    even = f"CAST(floor(({x}) * {p}) AS BIGINT) % 2 = 0"
    return (
        f"CASE WHEN ({x}) - {low} < {high} - ({x}) THEN {low} WHEN ({x}) - {low} > {high} - ({x}) THEN {high}"
        f" WHEN {even} THEN {low} ELSE {high} END"
    )
