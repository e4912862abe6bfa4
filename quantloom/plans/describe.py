"""What trials mean, in words."""

from __future__ import annotations

from collections.abc import Iterable

from quantloom.plans.expressions import Call, Field, parse

FIELD_WORDS = {"ret": "the hourly return", "close": "the price", "dollar_vol": "the volume in dollars", "taker_imb": "the excess of buyers", "trades": "the number of trades"}
WINDOW_WORDS = {
    "ts_ret": "change of {x} over {n} bars", "ts_std": "deviation of {x} over {n} bars", "ts_mean": "mean of {x} over {n} bars", "ts_sum": "sum of {x} over {n} bars",
    "ts_zscore": "distance of {x} from its mean over {n} bars",
}


def describe(expression: str) -> str | None:
    """What a signal of the usual form, a cross section of a window of a field, buys and sells; None for others."""
    node, turned = parse(expression), False
    if isinstance(node, Call) and node.name == "neg":
        node, turned = node.of, True
    match node:
        case Call(name=("cs_zscore" | "cs_rank" | "cs_demean"), of=Call(name=window, of=Field(name=field), parameters=(n,))) if window in WINDOW_WORDS and field in FIELD_WORDS:
            phrase = WINDOW_WORDS[window].format(n=n, x=FIELD_WORDS[field])
            bought, sold = ("least", "most") if turned else ("most", "least")
            return f"buys the {bought} and sells the {sold} {phrase}"
    return None


def counted(trials: Iterable[tuple[str, int]]) -> str:
    """How the number of trials, of (expression, hours between rebalances), comes about."""
    pairs = list(trials)

    def many(n: int, one: str, more: str) -> str:
        return f"{n} {one if n == 1 else more}"

    plain = [e.removeprefix("neg(").removesuffix(")") if e.startswith("neg(") else e for e, _ in pairs]
    return ", ".join((
        many(len(set(plain)), "signal", "signals"), many(len({e.startswith("neg(") for e, _ in pairs}), "sign", "signs"),
        many(len({every for _, every in pairs}), "rebalancing interval", "rebalancing intervals"), many(len(pairs), "trial", "trials"),
    ))
