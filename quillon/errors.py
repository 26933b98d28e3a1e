"""Errors of the language: one class per code, usable on the driver and inside plans."""

from __future__ import annotations

import re

#: The names and codes that queries see.
CODES = {
    "cancelled_err": -64,
    "operation_err": -63,
    "num_arguments_err": -62,
    "type_err": -61,
    "value_err": -60,
    "overflow_err": -59,
    "zero_div_err": -58,
    "max_quota_err": -57,
    "auth_err": -56,
    "forbidden_err": -55,
    "lookup_err": -54,
    "bad_data_err": -53,
    "syntax_err": -52,
    "node_err": -51,
    "assert_err": -50,
}
USER_CODE = -100


class LangError(Exception):
    """An error with a code from -127 to -50 (others are internal and can't be caught in a query)."""

    code = USER_CODE

    def __init__(self, msg: str = "", code: int | None = None):
        super().__init__(msg)
        self.msg = msg
        if code is not None:
            self.code = code


BY_NAME: dict[str, type[LangError]] = {n: type("".join(p.title() for p in n.split("_")[:-1]) + "Error", (LangError,), {"code": c}) for n, c in CODES.items()}
BY_CODE = {c.code: c for c in BY_NAME.values()}
OperationError, NumArgumentsError, TypeError_, ValueError_, OverflowError_, ZeroDivError, LookupError_, SyntaxError_, AssertError, BadDataError, ForbiddenError, AuthError = (
    BY_NAME[n] for n in ("operation_err", "num_arguments_err", "type_err", "value_err", "overflow_err", "zero_div_err", "lookup_err", "syntax_err", "assert_err", "bad_data_err", "forbidden_err", "auth_err")
)


def make(code: int, msg: str) -> LangError:
    return BY_CODE[code](msg) if code in BY_CODE else LangError(msg, code)


#: Conditions of Spark's ANSI mode, as codes of the language.
_SPARK = [("ARITHMETIC_OVERFLOW", -59), ("BINARY_ARITHMETIC_OVERFLOW", -59), ("CAST_OVERFLOW", -59), ("DIVIDE_BY_ZERO", -58), ("INVALID_ARRAY_INDEX", -54), ("CAST_INVALID_INPUT", -60), ("REMAINDER_BY_ZERO", -58)]


def from_spark(e: Exception) -> LangError | None:
    """The language's error that a failed Spark job stands for: raised by a guard as "[code] message", or by ANSI mode."""
    text = str(e)
    if m := re.search(r"\[(-\d+)\] ([^\n]*)", text):
        return make(int(m[1]), re.sub(r"['\"]?( SQLSTATE.*)?$", "", m[2]))
    for condition, code in _SPARK:
        if condition in text:
            return make(code, condition.lower().replace("_", " "))
    return None
