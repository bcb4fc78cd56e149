"""Account numbers beside other words."""

from cohortlens.llm import pii

ACCOUNTS = [
    ("DE89370400440532013000 Please pay", ["DE89370400440532013000"]),
    ("DE89 3704 0044 0532 0130 00 Thanks", ["DE89 3704 0044 0532 0130 00"]),
    ("DE89370400440532013000 4 times", ["DE89370400440532013000"]),
    ("GB82WEST12345698765432 BIC NWBKGB2L", ["GB82WEST12345698765432"]),
    ("AB12 DE89 3704 0044 0532 0130 00.", ["DE89 3704 0044 0532 0130 00"]),
    ("DE89370400440532013000 GB82WEST12345698765432", ["DE89370400440532013000", "GB82WEST12345698765432"]),
    ("MT84 MALT 0110 0001 2345 MTLC AST0 01S A", ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"]),
    ("NO9386011117947, NO9386011117948 NO93860111179470", ["NO9386011117947"]),
    ("XDE89370400440532013000 DE89370400440532013000x DE8937040044053201300", []),
]


def coded(code, body):
    digits = "".join(str(int(c, 36)) for c in body + code + "00")
    return f"{code}{98 - int(digits) % 97:02d}{body}"


def test_account_numbers_end_where_they_end(spark):
    other = coded("QQ", "12345678901234")  # a code of no listed country
    cases = [*ACCOUNTS, (f"{other} Next {other} 7 Up", [other, other])]
    frame = spark.createDataFrame([(t, w) for t, w in cases], "text string, wanted array<string>")
    for r in pii.find_pii(frame).collect():
        assert [r.text[x.start : x.end] for x in r.pii if x.kind == "iban"] == r.wanted, r.text
