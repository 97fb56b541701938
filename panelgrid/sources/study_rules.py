"""What a study document may say, value by value, and what has to hold between its blocks.

The rules are a table of dotted paths. A document is flattened to such paths, so a missing, unknown, mistyped or
unusable value is found the same way in every block, and the resolved document is the table's defaults with the
document's values over them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date
from typing import Any

_MUST = object()


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    path: str
    kind: str  # of KINDS
    default: Any = _MUST
    holds: Callable[[Any], bool] = lambda v: True
    says: str = ""


def _is_whole(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _is_date(v: Any) -> bool:
    try:
        return isinstance(v, date) or bool(date.fromisoformat(v))
    except (TypeError, ValueError):
        return False


KINDS: dict[str, Callable[[Any], bool]] = {
    "whole number": _is_whole,
    "number": lambda v: _is_whole(v) or isinstance(v, float),
    "text": lambda v: isinstance(v, str),
    "text or nothing": lambda v: v is None or isinstance(v, str),
    "yes or no": lambda v: isinstance(v, bool),
    "date": _is_date,
    "list": lambda v: isinstance(v, (list, tuple)),
    "pair of dates": lambda v: isinstance(v, (list, tuple)) and len(v) == 2 and all(map(_is_date, v)),
}
_positive, _not_negative, _named = (lambda v: v > 0), (lambda v: v >= 0), bool


def _rules(prefix: str, *rules: tuple) -> tuple[Rule, ...]:
    return tuple(Rule(f"{prefix}.{name}", *rest) for name, *rest in rules)


#: Names, defaults and bounds of a study's blocks.
RULES: tuple[Rule, ...] = (
    *_rules("study", ("name", "text", "unnamed_study", _named, "can't be empty"), ("seed", "whole number", 42, _not_negative, "can't be negative")),
    *_rules(
        "qlib_init",
        ("provider_uri", "text", _MUST, _named, "can't be empty"),
        ("region", "text", "cn", lambda v: v in ("cn", "us"), "has to be cn or us"),
        ("kernels", "whole number", 1, _positive, "has to be positive"),
        ("expression_cache", "text or nothing", None),
        ("dataset_cache", "text or nothing", None),
        ("mlflow_uri", "text or nothing", None),
        ("default_exp_name", "text", "alpha_research"),
        ("allow_multiprocessing", "yes or no", False),
    ),
    *_rules("data_handler", ("class", "text", "AlphaHandlerLP"), ("module_path", "text", "qresearch.data.handlers")),
    *_rules(
        "data_handler.kwargs",
        ("start_time", "date"),
        ("end_time", "date"),
        ("fit_start_time", "date"),
        ("fit_end_time", "date"),
        ("instruments", "text", _MUST, _named, "has to name a market"),
        ("freq", "text", "day"),
        ("infer_processors", "list", ()),
        ("learn_processors", "list", ()),
    ),
    *_rules("segments", ("train", "pair of dates"), ("valid", "pair of dates"), ("test", "pair of dates"), ("purge_radius", "whole number", 0, _not_negative, "can't be negative")),
    *_rules("model", ("class", "text", "StudentTSeqModel"), ("module_path", "text", "qresearch.models.qlib_adapter")),
    *_rules(
        "model.kwargs",
        *((name, "whole number", default, _positive, "has to be positive") for name, default in (("d_feat", 158), ("seq_len", 20), ("hidden_size", 128), ("num_layers", 2), ("n_epochs", 100), ("batch_size", 1024), ("early_stop", 20))),
        ("encoder", "text", "gru"),
        ("loss", "text", "student_t"),
        ("lambda_rank", "number", 0.3, _not_negative, "can't be negative"),
        ("lr", "number", 1e-3, _positive, "has to be positive"),
        ("seed", "whole number", 42, _not_negative, "can't be negative"),
        ("nu_min", "number", 2.05, lambda v: v > 2, "has to exceed 2, below which there is no variance"),
    ),
    *_rules("backtest", ("start_time", "date"), ("end_time", "date"), ("benchmark", "text", "SH000300", _named, "has to name an index"), ("account", "number", 1e8, _positive, "has to be positive")),
    *_rules(
        "backtest.exchange_kwargs",
        *((name, "number", default, _not_negative, "can't be negative") for name, default in (("open_cost", 0.0015), ("close_cost", 0.0025), ("min_cost", 5.0))),
        ("trade_unit", "whole number", 100, lambda v: v == 100, "has to be 100 shares"),
        ("limit_threshold", "number", 0.095, lambda v: 0 < v < 1, "has to lie between 0 and 1"),
        ("deal_price", "text", "close", lambda v: v in ("close", "open"), "has to be close or open"),
    ),
    *_rules("backtest.strategy", ("class", "text", "CostAwareMVStrategy"), ("module_path", "text", "qresearch.portfolio.strategies")),
    *_rules(
        "backtest.strategy.kwargs",
        ("topk", "whole number", 50, _positive, "has to be positive"),
        ("n_drop", "whole number", 5, _not_negative, "can't be negative"),
        ("risk_degree", "number", 0.95, lambda v: 0 < v <= 1, "has to be a share"),
        ("rebalance", "text", "daily"),
    ),
    *_rules("backtest.executor", ("class", "text", "SimulatorExecutor"), ("module_path", "text", "qlib.backtest.executor")),
    *_rules("backtest.executor.kwargs", ("time_per_step", "text", "day"), ("generate_portfolio_metrics", "yes or no", True)),
)
#: Blocks without which there is no study.
REQUIRED = ("qlib_init", "data_handler", "segments", "model", "backtest")
COSTS = ("open_cost", "close_cost", "min_cost")

_BY_PATH = {r.path: r for r in RULES}
_INNER = {path.rsplit(".", k)[0] for path in _BY_PATH for k in range(1, path.count(".") + 1)}


def _flat(value: Any, at: str = "") -> dict[str, Any]:
    """Values by path, down to the paths that the rules know."""
    out = {}
    for key, inner in value.items():
        path = f"{at}.{key}" if at else str(key)
        if path in _INNER:
            if inner is not None and not isinstance(inner, Mapping):
                raise ConfigError(f"{path} has to be a mapping, not {inner!r}")
            out |= _flat(inner or {}, path)
        else:
            out[path] = inner
    return out


def _day(v: Any) -> date:
    return v if isinstance(v, date) else date.fromisoformat(v)


def _between_blocks(v: Mapping[str, Any]) -> list[str]:
    """What doesn't hold between the values."""
    handler, back = (lambda k: _day(v[f"data_handler.kwargs.{k}"])), (lambda k: _day(v[f"backtest.{k}"]))
    ends = {name: tuple(map(_day, v[f"segments.{name}"])) for name in ("train", "valid", "test")}
    strategy = "backtest.strategy.kwargs"
    rules = {
        "the data handler ends before it starts": handler("end_time") < handler("start_time"),
        "the data handler's fit ends before it starts": handler("fit_end_time") < handler("fit_start_time"),
        "processors are fitted beyond the train segment": handler("fit_end_time") > ends["train"][1],
        "the data handler starts after the train segment": handler("start_time") > ends["train"][0],
        "the data handler ends before a segment does": handler("end_time") < max(ends["valid"][1], ends["test"][1]),
        "the backtest has to end after it starts": back("end_time") <= back("start_time"),
        "the backtest leaves the test segment": back("start_time") < ends["test"][0] or back("end_time") > ends["test"][1],
        "n_drop has to be less than topk": v[f"{strategy}.n_drop"] >= v[f"{strategy}.topk"],
        "more than one kernel needs allow_multiprocessing": v["qlib_init.kernels"] != 1 and not v["qlib_init.allow_multiprocessing"],
    }
    return [text for text, broken in rules.items() if broken]


def resolve(document: Mapping[str, Any], *, allow_zero_cost: bool = False) -> dict[str, Any]:
    """All values of a study by path. Everything that is wrong is told at once. A cost of zero makes results gross,
    so it has to be allowed."""
    if absent := [b for b in REQUIRED if b not in document]:
        raise ConfigError(f"missing blocks: {', '.join(absent)}")
    given, wrong = _flat(document), []
    wrong += [f"{path} is unknown" for path in given if path not in _BY_PATH]
    values = {}
    for rule in RULES:
        value = given.get(rule.path, rule.default)
        if value is _MUST:
            wrong.append(f"{rule.path} is missing")
        elif not KINDS[rule.kind](value):
            wrong.append(f"{rule.path} has to be a {rule.kind}, not {value!r}")
        elif not rule.holds(value):
            wrong.append(f"{rule.path} {rule.says}, not {value!r}")
        values[rule.path] = value
    if not wrong:
        wrong = _between_blocks(values)
        if not allow_zero_cost:
            wrong += [f"backtest.exchange_kwargs.{c} is zero" for c in COSTS if values[f"backtest.exchange_kwargs.{c}"] == 0]
    if wrong:
        raise ConfigError("; ".join(wrong))
    return values
