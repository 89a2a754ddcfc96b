"""Composable panel terms: ``Mean(field("close"), 5) / field("close")`` or the same as text.

Spark forbids a window inside a window, so every nesting level of window terms becomes one
``withColumns`` step; levels share one window spec and therefore one shuffle by instrument.
"""

import ast
import math
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import elem as E
from tidepanel.functions import frames as B
from tidepanel.functions import growing as G
from tidepanel.functions import rolling as R
from tidepanel.operators.scale import bounded, with_chunks

INFINITE = math.inf
#: So many moving aggregates of one set are taken together from arrays.
WIDE = 12


class Term:
    """A column to be: its text, its inputs, and how to build it from the columns of the inputs."""

    def __init__(self, text, inputs, build, back=0, ahead=0, window=False, may_inf=False, other=None, attach=None, frames=None):
        self.text, self.inputs, self.build, self.window, self.other, self.attach = text, inputs, build, window, other, attach
        self.back = back + max([i.back for i in inputs], default=0)
        self.ahead = ahead + max([i.ahead for i in inputs], default=0)
        self.level = max([i.level for i in inputs], default=0) + (1 if window else 0)
        # (aggregate of functions/frames.py, rows, inputs, more arguments): the same value from arrays
        self.frames = frames
        self.may_inf = may_inf or (not window and any(i.may_inf for i in inputs))

    def __str__(self):
        return self.text

    def _two(self, other, name, fn, flip=False):
        a, b = (other, self) if flip else (self, other)
        return pair(name, fn)(a, b)

    def __add__(self, o): return Add(self, o)
    def __radd__(self, o): return Add(o, self)
    def __sub__(self, o): return Sub(self, o)
    def __rsub__(self, o): return Sub(o, self)
    def __mul__(self, o): return Mul(self, o)
    def __rmul__(self, o): return Mul(o, self)
    def __truediv__(self, o): return Div(self, o)
    def __rtruediv__(self, o): return Div(o, self)
    def __pow__(self, o): return Power(self, o)
    def __gt__(self, o): return Gt(self, o)
    def __ge__(self, o): return Ge(self, o)
    def __lt__(self, o): return Lt(self, o)
    def __le__(self, o): return Le(self, o)
    def __eq__(self, o): return Eq(self, o)
    def __ne__(self, o): return Ne(self, o)
    def __and__(self, o): return And(self, o)
    def __or__(self, o): return Or(self, o)
    def __invert__(self): return Not(self)
    __hash__ = object.__hash__


def field(name):
    return Term(f"${name}", (), lambda cols, env: F.col(name))


def const(value):
    return Term(repr(value), (), lambda cols, env: E.lift(value))


def term(x):
    return x if isinstance(x, Term) else parse(x) if isinstance(x, str) else const(x)


def single(name, fn, may_inf=False):
    def make(x):
        x = term(x)
        return Term(f"{name}({x})", (x,), lambda cols, env: fn(cols[0]), may_inf=may_inf)

    return make


def pair(name, fn, may_inf=False):
    def make(a, b):
        a, b = term(a), term(b)
        return Term(f"{name}({a},{b})", (a, b), lambda cols, env: fn(cols[0], cols[1]), may_inf=may_inf)

    return make


Abs = single("Abs", F.abs)
Sign = single("Sign", E.sign)
Log = single("Log", E.log, may_inf=True)
Not = single("Not", lambda c: ~c)
IsNull = single("IsNull", E.is_null)
IsInf = single("IsInf", E.is_inf)
Power = pair("Power", E.power, may_inf=True)
Add = pair("Add", lambda a, b: a + b)
Sub = pair("Sub", lambda a, b: a - b)
Mul = pair("Mul", lambda a, b: a * b)


def Div(a, b):
    a, b = term(a), term(b)
    # inf / inf is missing; with one finite side no NaN can appear
    fn = (lambda cols, env: E.no_nan(E.div(*cols))) if a.may_inf and b.may_inf else (lambda cols, env: E.div(*cols))
    return Term(f"Div({a},{b})", (a, b), fn, may_inf=True)


Greater = pair("Greater", E.greater)
Less = pair("Less", E.less)
Gt, Ge, Lt, Le, Eq, Ne = (pair(n, f) for n, f in zip(("Gt", "Ge", "Lt", "Le", "Eq", "Ne"), (E.gt, E.ge, E.lt, E.le, E.eq, E.ne)))
And = pair("And", lambda a, b: a & b)
Or = pair("Or", lambda a, b: a | b)


def If(cond, a, b):
    cond, a, b = term(cond), term(a), term(b)
    return Term(f"If({cond},{a},{b})", (cond, a, b), lambda cols, env: E.if_else(*cols))


def Select(cond, x):
    """Null where the condition fails, so that it fits into a wider select."""
    cond, x = term(cond), term(x)
    return Term(f"Select({cond},{x})", (cond, x), lambda cols, env: F.when(cols[0], cols[1]))


def Ref(x, n):
    x = term(x)
    if n == 0:
        build = lambda cols, env: F.first(cols[0]).over(env.w.rowsBetween(Window.unboundedPreceding, 0))
        return Term(f"Ref({x},0)", (x,), build, back=INFINITE, window=True)
    build = lambda cols, env: (F.lag(cols[0], n) if n > 0 else F.lead(cols[0], -n)).over(env.w)
    return Term(f"Ref({x},{n})", (x,), build, back=max(n, 0), ahead=max(-n, 0), window=True, may_inf=x.may_inf)


def Delta(x, n):
    x = term(x)
    return x - Ref(x, n)


def _input(t, col):
    """Windows work on doubles, without infinity, whatever the source field holds."""
    return E.finite(col.cast("double"))


def _moving(kind, n, inputs, *extra):
    """A window of n rows, as arrays give it; a growing one stays with Spark."""
    return (kind, n, inputs, extra) if isinstance(n, int) and n > 0 else None


def rolling(name, fn, position=False, raw=False, kind=None):
    def make(x, n, *extra):
        x = term(x)
        if 0 < n < 1:
            return EMA(x, n)
        text = ",".join([str(x), str(n), *map(str, extra)])

        def build(cols, env):
            col = cols[0] if raw else _input(x, cols[0])
            args = (col, env.w, n, *extra)
            return fn(*args, env.pos) if position else fn(*args)

        return Term(f"{name}({text})", (x,), build, back=INFINITE if n == 0 else n - 1, window=True, frames=kind and _moving(kind, n, (x,)))

    return make


Skew = rolling("Skew", R.skew)
Kurt = rolling("Kurt", R.kurt)
Max = rolling("Max", R.highest, kind="max")
Min = rolling("Min", R.lowest, kind="min")
_Mad = rolling("Mad", R.mad)
IdxMax = rolling("IdxMax", R.idx_max, position=True, raw=True)
IdxMin = rolling("IdxMin", R.idx_min, position=True, raw=True)


def _base(kind, x, n, fn):
    """A plain window aggregate that several functions share; equal texts are computed once."""
    build = lambda cols, env: fn(_input(x, cols[0])).over(R.frame(env.w, n))
    frames = _moving(kind.removeprefix("plain_"), n, (x,)) if kind != "list" else None
    return Term(f"_{kind}({x},{n})", (x,), build, back=INFINITE if n == 0 else n - 1, window=True, frames=frames)


_PLACE = Term("_place()", (), lambda cols, env: env.place)


def _placed(kind, x, n, fn):
    """A window aggregate of x and its position."""
    build = lambda cols, env: fn(_input(x, cols[0]), env.place).over(R.frame(env.w, n))
    frames = _moving(kind, n, (x, _PLACE))
    return Term(f"_{kind}({x},{n})", (x,), build, back=INFINITE if n == 0 else n - 1, window=True, frames=frames)


def _values(x, n):
    return _base("list", x, n, F.collect_list)


def _growing(name, x, fn, *extra):
    """A function of all rows so far that no running aggregate gives: it is computed as a table and joined back."""
    text = ",".join([str(x), "0", *map(str, extra)])
    value = Term(f"_growing_input({x})", (x,), lambda cols, env: _input(x, cols[0]))
    return Term(f"{name}({text})", (value,), None, back=INFINITE, window=True, attach=lambda df, column, out: fn(df, column, out, *extra))


def _derived(name, text, inputs, fn, frames=None):
    return Term(f"{name}({text})", tuple(inputs), lambda cols, env: fn(*cols), frames=frames)


def _rolled(name):
    """Row-count forms; a window below one means an exponential mean."""

    def wrap(make):
        def outer(x, n, *extra):
            x = term(x)
            return EMA(x, n) if 0 < n < 1 else make(x, n, *extra)

        outer.__name__ = name
        return outer

    return wrap


@_rolled("Sum")
def Sum(x, n):
    return _base("plain_sum", x, n, F.sum)


@_rolled("Count")
def Count(x, n):
    return _derived("Count", f"{x},{n}", [_base("count", x, n, F.count)], lambda k: k.cast("double"))


@_rolled("Mean")
def Mean(x, n):
    return _base("plain_mean", x, n, F.avg)


# Second moments are aggregates of their own window: a large value outside it cannot cost them digits.
@_rolled("Var")
def Var(x, n):
    return _base("var", x, n, F.var_samp)


@_rolled("Std")
def Std(x, n):
    return _derived("Std", f"{x},{n}", [Var(x, n)], F.sqrt, _moving("std", n, (x,)))


@_rolled("Slope")
def Slope(x, n):
    return _placed("slope", x, n, F.regr_slope)


@_rolled("Resi")
def Resi(x, n):
    """Last residual: value minus the fitted line at its own position."""
    here = Term(f"_here({x})", (x,), lambda cols, env: env.place)
    value = Term(f"_value({x})", (x,), lambda cols, env: _input(x, cols[0]))
    line = [_placed("slope", x, n, F.regr_slope), _placed("intercept", x, n, F.regr_intercept)]
    return _derived("Resi", f"{x},{n}", [value, here, *line], lambda v, p, slope, start: v - start - slope * p, _moving("resi", n, (x, _PLACE)))


@_rolled("Rsquare")
def Rsquare(x, n):
    """Explained share; missing in a flat window."""
    return _derived("Rsquare", f"{x},{n}", [Var(x, n), _placed("r2", x, n, F.regr_r2)], lambda var, r2: F.when(var > 4e-10, r2), _moving("rsquare", n, (x, _PLACE)))


@_rolled("WMA")
def WMA(x, n):
    rows = Term(f"_rows({x},{n})", (x,), lambda cols, env: F.count(F.lit(1)).over(R.frame(env.w, n)), back=INFINITE if n == 0 else n - 1, window=True)
    place = Term(f"_place_of_row({x})", (x,), lambda cols, env: env.place)
    sums = [_base("count", x, n, F.count), _base("plain_sum", x, n, F.sum), _placed("weighted", x, n, lambda v, p: F.sum(v * p))]
    return _derived("WMA", f"{x},{n}", [*sums, rows, place], R.wma_of_sums)


@_rolled("Mad")
def Mad(x, n):
    return _Mad(x, n) if n else _growing("Mad", x, G.mean_distance)


@_rolled("Quantile")
def Quantile(x, n, q):
    if n == 0:
        return _growing("Quantile", x, G.quantile, q)
    ordered = _derived("_sorted", f"{x},{n}", [_values(x, n)], F.array_sort)
    return _derived("Quantile", f"{x},{n},{q}", [ordered], lambda v: R.quantile_of_list(v, q), _moving("quantile", n, (x,), float(q)))


@_rolled("Med")
def Med(x, n):
    return Quantile(x, n, 0.5)


@_rolled("Rank")
def Rank(x, n):
    if n == 0:
        return _growing("Rank", x, G.rank)
    here = Term(f"_value({x})", (x,), lambda cols, env: _input(x, cols[0]))
    return _derived("Rank", f"{x},{n}", [here, _values(x, n)], R.rank_in_list, _moving("rank", n, (x,)))


def _paired(x, y):
    """x where both are present."""
    build = lambda cols, env: F.when(_input(y, cols[1]).isNotNull(), _input(x, cols[0]))
    return Term(f"_paired({x},{y})", (x, y), build)


def Cov(x, y, n):
    x, y = term(x), term(y)
    build = lambda cols, env: F.covar_samp(_input(x, cols[0]), _input(y, cols[1])).over(R.frame(env.w, n))
    return Term(f"Cov({x},{y},{n})", (x, y), build, back=INFINITE if n == 0 else n - 1, window=True, frames=_moving("cov", n, (x, y)))


def Corr(x, y, n):
    x, y = term(x), term(y)
    parts = [Cov(x, y, n), Var(_paired(x, y), n), Var(_paired(y, x), n), Var(x, n), Var(y, n)]
    return _derived("Corr", f"{x},{y},{n}", parts, R.corr_of_vars, _moving("corr", n, (x, y)))


def FFillNan(x):
    x = term(x)
    return Term(f"FFillNan({x})", (x,), lambda cols, env: R.last_valid(cols[0], env.w), back=INFINITE, window=True, may_inf=x.may_inf)


def BFillNan(x):
    x = term(x)
    return Term(f"BFillNan({x})", (x,), lambda cols, env: R.next_valid(cols[0], env.w), ahead=INFINITE, window=True, may_inf=x.may_inf)


def DayLast(x):
    """Last non-null value of the trade day on every row of that day."""
    x = term(x)

    def build(cols, env):
        day = Window.partitionBy(*env.keys, F.to_date("datetime")).orderBy("cal_ix")
        return F.last(cols[0], ignorenulls=True).over(day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    return Term(f"DayLast({x})", (x,), build, back=INFINITE, ahead=INFINITE, window=True, may_inf=x.may_inf)


def Date(x):
    x = term(x)
    return Term(f"Date({x})", (x,), lambda cols, env: F.to_date("datetime"))


def EMA(x, n):
    """Exponential mean with weights by absolute position.

    Written with running sums: rows are cut into blocks of K slots with (1-a)^K below double precision,
    so the value needs the running sum of its own block and the decayed total of the block before.
    ``n`` is a span, or the weight itself when 0 < n < 1; 0 takes span = rows so far.
    """
    x = term(x)
    if n == 0:
        return _ema_growing(x)
    alpha = n if 0 < n < 1 else 2.0 / (n + 1)
    q = 1.0 - alpha
    if q <= 0:
        return FFillNan(x)
    # q^K about 1e-18: older blocks are below double precision
    k = max(1, math.ceil(-math.log(1e-18) / -math.log(q)))

    def block_sum(kind, whole):
        def build(cols, env):
            v = _input(x, cols[0])
            inside = F.pmod(env.pos, F.lit(k)).cast("double")
            grow = F.pow(F.lit(1.0 / q), inside)
            grown = F.when(v.isNotNull(), v * grow if kind == "num" else grow)
            by = Window.partitionBy(*env.keys, F.expr(f"cal_ix div {k}"))
            if whole:
                return F.sum(grown).over(by) * F.lit(q ** (k - 1))
            return F.sum(grown).over(by.orderBy("cal_ix").rowsBetween(Window.unboundedPreceding, 0)) / grow

        return Term(f"_ema_{kind}_{whole}({x},{n})", (x,), build, back=k, window=True)

    def carried(kind):
        mine, last_total = block_sum(kind, False), Ref(block_sum(kind, True), 1)

        def spread(cols, env):
            by = Window.partitionBy(*env.keys, F.expr(f"cal_ix div {k}")).orderBy("cal_ix")
            return F.first(cols[0]).over(by.rowsBetween(Window.unboundedPreceding, 0))

        # the row before a block holds the total of the block before it
        before = Term(f"_ema_before_{kind}({x},{n})", (last_total,), spread, window=True)
        decay = lambda cols, env: F.coalesce(cols[0], F.lit(0.0)) + F.coalesce(
            cols[1] * F.pow(F.lit(q), F.pmod(env.pos, F.lit(k)).cast("double") + 1), F.lit(0.0)
        )
        return Term(f"_ema_carried_{kind}({x},{n})", (mine, before), decay)

    num, den = carried("num"), carried("den")
    ratio = Term(f"_ema_ratio({x},{n})", (num, den), lambda cols, env: cols[0] / F.when(cols[1] > 0, cols[1]))
    out = FFillNan(ratio)
    out.text = f"EMA({x},{n})"
    return out


def _ema_growing(x):
    """Weights follow the number of rows so far; missing rows keep their weight in the scale."""

    def build(cols, env):
        f = R.frame(env.w, 0)
        values = F.collect_list(F.coalesce(_input(x, cols[0]), F.lit(float("nan")))).over(f)
        rows = F.count(F.lit(1)).over(f).cast("double")
        a = 1.0 - 2.0 / (1.0 + rows)
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
        step = lambda acc, v: F.struct(
            (acc["s"] * a + F.nanvl(v, F.lit(0.0))).alias("s"), (acc["w"] * a + 1.0).alias("w")
        )
        return F.aggregate(values, zero, step, lambda acc: acc["s"] / acc["w"])

    return Term(f"EMA({x},0)", (x,), build, back=INFINITE, window=True)


def ChangeInstrument(code, x):
    """The whole term on one other instrument, aligned by time."""
    x = term(x)
    return Term(f"ChangeInstrument({code},{x})", (), None, other=(code, x))


def Mask(x, code):
    return ChangeInstrument(code, x)


class _Env:
    def __init__(self, keys, size=0):
        self.keys = keys
        self.w = Window.partitionBy(*keys).orderBy("cal_ix")
        self.pos = F.col("cal_ix")
        # small numbers inside a chunk, so that sums over squared positions stay exact
        self.place = (F.col("cal_ix") - F.col("chunk") * size if size else F.col("cal_ix")).cast("double")


FUNCTIONS = {
    f.__name__ if hasattr(f, "__name__") and f.__name__ != "make" else n: f
    for n, f in list(globals().items())
    if n[0].isupper() and callable(f) and n not in ("Term", "Window", "INFINITE")
}


def register(name, fn):
    """Add a user function ``fn(*terms_or_numbers) -> Term``; an existing name is replaced with a warning."""
    import warnings

    if name in FUNCTIONS:
        warnings.warn(f"operator {name} is replaced")
    FUNCTIONS[name] = fn


_BINARY = {ast.Add: "Add", ast.Sub: "Sub", ast.Mult: "Mul", ast.Div: "Div", ast.Pow: "Power", ast.BitAnd: "And", ast.BitOr: "Or"}
_COMPARE = {ast.Gt: "Gt", ast.GtE: "Ge", ast.Lt: "Lt", ast.LtE: "Le", ast.Eq: "Eq", ast.NotEq: "Ne"}


def parse(text):
    """Text form of the same functions, read with Python's own parser; nothing is evaluated."""
    tree = ast.parse(re.sub(r"\$(\w+)", r"_col_\1", text.strip()), mode="eval")

    def walk(n):
        if isinstance(n, ast.Constant):
            return n.value
        if isinstance(n, ast.Name) and n.id.startswith("_col_"):
            return field(n.id[5:])
        if isinstance(n, ast.BinOp):
            return FUNCTIONS[_BINARY[type(n.op)]](walk(n.left), walk(n.right))
        if isinstance(n, ast.Compare) and len(n.ops) == 1:
            return FUNCTIONS[_COMPARE[type(n.ops[0])]](walk(n.left), walk(n.comparators[0]))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            v = walk(n.operand)
            return 0 - v if isinstance(v, Term) else -v
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Invert):
            return Not(walk(n.operand))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS:
            return FUNCTIONS[n.func.id](*[walk(a) for a in n.args])
        raise ValueError(f"not a panel expression: {ast.dump(n)}")

    return term(walk(tree.body))


def lookback_bounds(terms):
    """(rows before, rows after) that a set of terms reads around each row."""
    return max([t.back for t in terms], default=0), max([t.ahead for t in terms], default=0)


def features(panel, exprs, start=None, end=None, calendar_rows=None, keep=(), chunk_rows=2048):
    """Add one column per expression to an aligned panel (instrument, datetime, cal_ix, fields).

    The time range is applied after the windows, so a row inside it sees the rows before it. With finite
    lookback the instruments are cut into chunks with copied edges, so that a long one spreads over tasks.
    """
    named = {n: term(e) for n, e in exprs.items()}
    df, joined = panel, {}

    def foreign(t, out):
        if t.other:
            out[t.text] = t.other
        for i in t.inputs:
            foreign(i, out)
        return out

    for t in named.values():
        for text, (code, inner) in foreign(t, {}).items():
            if text in joined:
                continue
            name = joined[text] = f"__o{len(joined)}"
            other = features(panel.where(F.col("instrument") == code), {name: inner}, chunk_rows=chunk_rows)
            # one instrument: at most one row per calendar slot
            df = df.join(bounded(other.select("cal_ix", name), calendar_rows), "cal_ix", "left")

    back, ahead = lookback_bounds(named.values())
    chunked = back < INFINITE and ahead < INFINITE and (back or ahead)
    keys = ["instrument"]
    if chunked:
        size = max(chunk_rows, 4 * (int(back) + int(ahead) + 1))
        df = with_chunks(df, "cal_ix", int(back), int(ahead), size)
        keys.append("chunk")
    env = _Env(keys, size if chunked else 0)
    made = {}

    def column(t):
        if t.text in made:
            return F.col(made[t.text])
        if t.other:
            return F.col(joined[t.text])
        return t.build([column(i) for i in t.inputs], env)

    def read(t, wide):
        return t.frames[2] if wide and t.frames else t.inputs

    def windows(t, out, wide):
        if t.window or (wide and t.frames):
            out[t.text] = t
        for i in read(t, wide):
            windows(i, out, wide)
        return out

    def found(wide):
        out = {}
        for t in named.values():
            windows(t, out, wide)
        return out

    todo = found(True)
    wide = sum(1 for t in todo.values() if t.frames) >= WIDE
    if not wide:
        todo = found(False)

    def turn(t):
        """Passes over arrays up to and with this term."""
        return max([turn(i) for i in read(t, wide)], default=0) + (1 if wide and t.frames else 0)

    turns = {t.text: turn(t) for t in todo.values()}
    levels = max([t.level for t in todo.values()], default=0)
    for now, level in [(k, i) for k in range(max(turns.values(), default=0) + 1) for i in range(levels + 1)]:
        if level == 0:
            framed = [t for t in todo.values() if wide and t.frames and turns[t.text] == now]
            if framed:
                inputs = {i.text: i for t in framed for i in t.frames[2]}
                at = {text: k for k, text in enumerate(inputs)}
                wanted = [(f"__w{len(made) + k}", t.frames[0], t.frames[1], tuple(at[i.text] for i in t.frames[2]), t.frames[3]) for k, t in enumerate(framed)]
                df = B.attach(df, keys, env.w, [_input(i, column(i)) for i in inputs.values()], wanted)
                made.update({t.text: w[0] for t, w in zip(framed, wanted)})
            continue
        step, inputs = {}, {}
        for t in todo.values():
            if t.level == level and turns[t.text] == now and not (wide and t.frames):
                step[t.text] = (f"__w{len(made) + len(step)}", t)
                for i in t.inputs:
                    if i.inputs and i.text not in made and i.text not in inputs:
                        inputs[i.text] = (f"__i{len(made)}_{len(inputs)}", i)
        # compound inputs become columns once, so that several windows over them do not repeat the work
        if not step:
            continue
        if inputs:
            df = df.withColumns({n: column(i) for n, i in inputs.values()})
            made.update({text: n for text, (n, _) in inputs.items()})
        df = df.withColumns({n: column(t) for n, t in step.values() if not t.attach})
        # all tables are made from the panel before any of them is joined to it
        for table in [t.attach(df, made[t.inputs[0].text], n) for n, t in step.values() if t.attach]:
            df = df.join(table, ["instrument", "cal_ix"], "left")
        made.update({text: n for text, (n, _) in step.items()})
    if chunked:
        df = df.where("own")
    if start is not None:
        df = df.where(F.col("datetime") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("datetime") <= F.lit(end))
    return df.select("instrument", "datetime", "cal_ix", *keep, *[column(t).alias(n) for n, t in named.items()])
