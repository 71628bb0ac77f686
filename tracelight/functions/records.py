"""JSON message bytes to records and (path, value) entries, as Spark SQL expressions."""

from __future__ import annotations


def bracket_text(text: str) -> str:
    """Only the brackets of a JSON text, those inside strings left out."""
    plain = f"regexp_replace({text}, r'\\\\.', '')"
    return rf"""regexp_replace({plain}, r'"[^"]*"|[^\[\]{{}}"]+', '')"""


def _named(expression: str, name: str, body: str) -> str:
    """``body`` with ``name`` for the value of an expression, which is evaluated once."""
    return f"transform(array({expression}), {name} -> {body})[0]"


def _walk(brackets: str) -> str:
    """Last and deepest level, and how often the level returns to zero, over the brackets of a text."""
    step = """(acc, c) -> named_struct(
        'level', acc.level + if(c in ('{', '['), 1, -1),
        'deepest', greatest(acc.deepest, acc.level + if(c in ('{', '['), 1, 0)),
        'closed', acc.closed + if(acc.level = 1 and c in ('}', ']'), 1, 0))"""
    start = "named_struct('level', 0, 'deepest', 0, 'closed', 0)"
    return f"aggregate(split({brackets}, ''), {start}, {step})"


def nesting(text: str) -> str:
    """How deep objects and arrays are nested in a JSON text."""
    # "{}" and "[]" are by far the most common shapes and need no loop.
    return _named(bracket_text(text), "b", f"if(b in ('{{}}', '[]'), 1, {_walk('b')}.deepest)")


def _candidate(text: str) -> str:
    """``(text, levels)`` of a text whose brackets are those of one object or array, else null."""
    one = _named(_walk("b"), "w", "if(w.closed = 1 and w.level = 0, w.deepest, null)")
    levels = _named(bracket_text("t"), "b", f"if(b in ('{{}}', '[]'), 1, {one})")
    outer = "left(t, 1) in ('{', '[') and right(t, 1) in ('}', ']')"
    shaped = _named(f"if({outer}, {levels}, null)", "n", "if(n is null, null, named_struct('text', t, 'levels', n))")
    return _named(f"btrim({text}, ' \\t\\n\\r')", "t", shaped)


def record(data: str, decoded: str | None = None) -> str:
    """``(text, node, levels)`` of a message value (binary): its JSON text, the parsed VARIANT, null
    where the text is no JSON, and how deep it is nested.

    Whole value first; when its brackets are not those of one object or array, again from the first
    ``{``, else the first ``[``, which skips a binary prefix. The two exclude each other (the rest of
    a balanced text is not balanced), so the choice needs no parsing and the text is parsed once.
    ``decoded`` is a JSON text that goes before both where it is not null.
    """
    whole = f"if(is_valid_utf8(cast({data} as string)), cast({data} as string), null)"
    # One character per byte, so positions count bytes even where the text is no valid UTF-8.
    chars = f"decode({data}, 'ISO-8859-1')"
    start = f"if(instr({chars}, '{{') > 0, instr({chars}, '{{'), instr({chars}, '['))"
    rest = f"cast(substring({data}, {start}, length({data})) as string)"
    tail = f"if({start} > 1 and is_valid_utf8({rest}), {rest}, null)"
    choices = [_candidate(whole), _candidate(tail)]
    if decoded:
        ready = f"named_struct('text', {decoded}, 'levels', {nesting(decoded)})"
        choices.insert(0, f"if({decoded} is null, null, {ready})")
    parsed = "named_struct('text', p.text, 'node', try_parse_json(p.text), 'levels', p.levels)"
    return _named(f"coalesce({', '.join(choices)})", "p", parsed)


_ENTRY = "struct<path:string,node:variant,depth:int,in_object:boolean,is_root:boolean>"


def entries(
    node: str = "record",
    levels: str = "levels",
    *,
    expand_nested_lists: bool,
    include_arrays: bool = True,
    max_depth: int | None = None,
) -> str:
    """All leaves of a parsed record, nested ``levels`` deep, as an array of ``(path, node, …)``.

    A fold runs once per nesting level of this very record and opens every object and array found
    so far, so a flat record costs one round and no depth limit has to be planned in.
    ``depth`` counts levels the way the schemaless extraction does: an array directly inside an
    object opens at the level of that object.
    """
    nothing = f"cast(array() as array<{_ENTRY}>)"

    def bounded(depth: str, opened: str) -> str:
        return opened if max_depth is None else f"if({depth} > {int(max_depth)}, {nothing}, {opened})"

    def child(path: str, node: str, depth: str, in_object: str) -> str:
        return (
            f"named_struct('path', {path}, 'node', {node}, 'depth', {depth}, "
            f"'in_object', {in_object}, 'is_root', false)"
        )

    object_depth = "e.depth + 1"
    array_depth = "if(e.in_object, e.depth, e.depth + 1)"
    member = child("if(e.path = '', m.key, concat(e.path, '.', m.key))", "m.value", object_depth, "true")
    item = child("concat(e.path, '[', i, ']')", "x", array_depth, "false")
    as_object = "try_cast(e.node as map<string,variant>)"
    as_array = "try_cast(e.node as array<variant>)"
    members = bounded(object_depth, f"transform(map_entries({as_object}), m -> {member})")
    items = bounded(array_depth, f"transform({as_array}, (x, i) -> {item})") if include_arrays else nothing
    if not expand_nested_lists:
        # Only arrays that are object members are opened; a list in a list stays one value.
        items = f"case when e.is_root then {nothing} when e.in_object then {items} else array(e) end"
    opened = f"""case
        when {as_object} is not null then {members}
        when {as_array} is not null then {items}
        when e.is_root then {nothing}
        else array(e) end"""
    root = (
        f"array(named_struct('path', '', 'node', {node}, 'depth', -1, "
        "'in_object', false, 'is_root', true))"
    )
    rounds = f"sequence(1, greatest({levels}, 1))"
    return f"aggregate({rounds}, {root}, (acc, level) -> flatten(transform(acc, e -> {opened})))"
