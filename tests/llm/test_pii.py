import pytest

from threadloom.llm import pii as P

GIVEN = frozenset("anna omar grace will łukasz rosa zoë".split())
POSTS = "id long, plain_text string, cooked string, updated_at string"


def spots(text, kind=None):
    return [(s.kind, text[s.start : s.end]) for s in P.scan(text, GIVEN) if kind in (None, s.kind)]


@pytest.mark.parametrize("text,mail", [
    ("Mail a.b+c@mail.x-y.example now", "a.b+c@mail.x-y.example"), ("<J_DOE@EXAMPLE.COM>", "J_DOE@EXAMPLE.COM"), ("z(@)münz.example", "z(@)münz.example"), ("joe at post dot x dot example.", "joe at post dot x dot example"),
    ("joe (at) x (dot) org", "joe (at) x (dot) org"), ("joe[at]x[dot]org", "joe[at]x[dot]org"), ("連絡先はjoe@x.exampleです。", "joe@x.example"), ("joe＠x.org", "joe＠x.org"), ("joe @ x.example and", "joe @ x.example"), ("I AM joe AT x DOT net", "joe AT x DOT net"),
])
def test_mail(text, mail):
    assert spots(text, "email") == [("email", mail)]


@pytest.mark.parametrize("text", ["Use mod-loader@2.36.1 now", "Ping @brake_ghost87", "Run it @ 14.5 fps.", "look at the dot on the map", "a@b", "meet me at noon"])
def test_no_mail(text):
    assert spots(text, "email") == []


@pytest.mark.parametrize("text,kind,number", [
    ("call +44 (0)1632 960 814 twice", "phone", "+44 (0)1632 960 814"), ("(0491 570 158)", "phone", "0491 570 158"), ("((297) 555-0112)", "phone", "(297) 555-0112"), ("1-588-555-0132 ext. 64, text", "phone", "1-588-555-0132 ext. 64"),
    ("tel +33 1 99 00 52 75 33 impasse", "phone", "+33 1 99 00 52 75"), ("030/23125736", "phone", "030/23125736"), ("0049 30 23125 087", "phone", "0049 30 23125 087"), ("01.99.00.36.91,", "phone", "01.99.00.36.91"), ("+16975550192", "phone", "+16975550192"),
    ("my id is 985 06 8073.", "identity", "985 06 8073"), ("QQ 87 58 04 A.", "identity", "QQ 87 58 04 A"), ("00936436-I", "identity", "00936436-I"), ("passport Z01656713,", "identity", "Z01656713"), ("0000 3785 1356", "identity", "0000 3785 1356"), ("GIBRE317108K9BY", "identity", "GIBRE317108K9BY"), ("tax id 00 706 425 517", "identity", "00 706 425 517"),
])
def test_numbers(text, kind, number):
    assert (kind, number) in spots(text) and len([s for s in spots(text) if s[0] in ("phone", "identity")]) == 1


@pytest.mark.parametrize("text", ["Order 55506642 is open", "Ticket 20240981-093055", "Checksum 0037123456789abc", "Train 4472-0193-58", "slot 00-92-4471", "seed 482-19-70735", "IP 192.0.2.59", "grid 51.2083, -0.5583", "needs 082 555 wagons", "Part no. 555-A-0138", "post #120155", "748d6b74450cf48d5176891ec9f8bf5e"])
def test_no_numbers(text):
    assert spots(text) == []


@pytest.mark.parametrize("text,begin", [("at 165a Kot Gardens, X QQ17 4ZZ", "165a Kot Gardens"), ("142 Old Rashork Street", "142 Old"), ("Calle del Ditruck 25, 7º C", "Calle del Ditruck 25"), ("Via Rathull 26, 00579 K", "Via"), ("Boshockplatz 65, 00586", "Boshockplatz 65"), ("26 bis rue du Bizarn, 007", "26 bis rue"), ("Rua do Naz, 171, P", "Rua do Naz, 171"), ("480 W. Mas Blvd, Unit 2", "480 W."), ("Kozoststraße 68.", "Kozost")])
def test_address(text, begin):
    assert [t.startswith(begin) for _, t in spots(text, "address")] == [True]


def test_no_address():
    assert spots("Cinder Street station on Friday. Street lamps on level 83. The 13 Ridge Line.", "address") == []


def test_names():
    assert ("name", "Anna Velby") in spots("Signed: Anna Velby") and ("name", "Velby, Anna") in spots("PS Velby, Anna here")
    assert ("name", "Rosa van der Kest") in spots("Dr. Rosa van der Kest came") and ("name", "ŁUKASZ O'BOR") in spots("— ŁUKASZ O'BOR") and ("name", "Anna-Rosa Velby") in spots("Anna-Rosa Velby")
    for text in ("Anna said it worked.", "Will saving help?", "mail anna@x.example", "@Grace Period", "the_Anna Velby"):
        assert not [s for s in spots(text, "name")], text


def test_markup_places():
    raw = '<p>Mail <a href="mailto:joe@x.example">here</a> or a&#64;b&#46;example, <strong>Anna&nbsp;Velby</strong>.</p><aside data-username="Anna Velby">x</aside><span title="+44 1632 960136">y</span>'
    got = {(s.kind, raw[s.start : s.end]) for s in P.scan_html(raw, GIVEN)}
    assert got == {("email", "joe@x.example"), ("email", "a&#64;b&#46;example"), ("name", "Anna&nbsp;Velby"), ("phone", "+44 1632 960136")}


def test_broken_markup_is_read_in_time():
    raw = '<a href="x' * 20_000 + " tel +44 1632 960136"
    assert [s.kind for s in P.scan_html(raw, GIVEN)] == ["phone"]
    assert [s.kind for s in P.scan_html("I <3 it & tel +44 1632 960136 < that's", GIVEN)] == ["phone"]


def make(spark, rows, schema=POSTS):
    return spark.createDataFrame(rows, schema), spark.createDataFrame([(g.capitalize(),) for g in sorted(GIVEN)] + [(None,)], "given_name string")


def forum():
    """Names among decoys of one shape, as weak supervision needs many."""
    families = ["Velby", "Kestova", "Oakman", "Trimley", "Borstrom", "Lindgate"]
    rows = []
    for i in range(120):
        g, f = ("Anna", "Omar", "Rosa", "Grace")[i % 4], families[i % 6]
        rows.append((i, f"My real name is {g} {f}, by the way. Mail {g.lower()}{i}@x.example soon.", f"<p>My real name is <b>{g} {f}</b>, by the way.</p>", "2024-01-01T00:00:00Z"))
        rows.append((1000 + i, "The Grace Period perk lasts 20 minutes. Order 55506642 is open.", None, "2024-01-01T00:00:00Z"))
    return rows


def test_learns_names_from_decoys(spark):
    posts, given = make(spark, forum())
    got = {(r.post_id, r.field_name, r.kind) for r in P.found(posts, given).collect()}
    want = {(i, f, "name") for i in range(120) for f in ("plain_text", "cooked")} | {(i, "plain_text", "email") for i in range(120)}
    assert got == want


@pytest.mark.parametrize("times", [3, 40])
def test_one_person_in_many_posts(spark, times):
    """A family name that one person alone has is found however often the person signs or is mentioned."""
    signed = [(5000 + i, "Regards,\nWill Farnell", "<p>Regards,<br>Will Farnell</p>", "2024-01-01T00:00:00Z") for i in range(times)]
    plain = [(6000 + i, "See what came of it: Will Farnell. Will saving help?", None, "2024-01-01T00:00:00Z") for i in range(times)]
    posts, given = make(spark, forum() + signed + plain)
    got = {(r.post_id, r.field_name) for r in P.found(posts, given).collect() if r.kind == "name"}
    want = {(i, f) for i in range(120) for f in ("plain_text", "cooked")} | {(r[0], f) for r in signed for f in ("plain_text", "cooked")} | {(r[0], "plain_text") for r in plain}
    assert got == want


def test_surname_votes_are_by_share(spark):
    """An ordinary word after given names is no surname, an unshared surname is one; both at every size, counted once a post."""
    for times in (1, 12):
        rows = [(100 * k + i, f"Signed: {g} Velby", f"<b>Signed: {g} Velby</b>", None) for k in range(times) for i, g in enumerate(("Anna",))]
        rows += [(100_000 + 100 * k + i, f"Regards, {g} Could you look?", None, None) for k in range(times) for i, g in enumerate(("Omar", "Rosa", "Grace", "Will"))]
        rows += [(200_000 + k, "if you could", "<p class='velby'>anna.velby@x.example, we could</p>", None) for k in range(300 * times)]
        posts, _ = make(spark, rows)
        versions = P.latest_posts(posts)
        names = P.with_gazetteer(P.candidates(versions, GIVEN), versions).where("kind = 'name'")
        assert {(r.family, r.votes[-1]) for r in names.collect()} == {("velby", 1), ("could", -1)}, times


def test_versions_nulls_repeats_clashes(spark):
    a, b = "tel +44 1632 960136", "nothing"
    rows = [(1, a, None, "2024-01-01T00:00:00Z"), (1, b, None, "2024-01-02T00:00:00Z"), (2, a, "", "2024-01-01T00:00:00Z"), (2, a, "", "2024-01-01T00:00:00Z"), (3, None, None, None), (None, a, None, None), (4, "x " * 200_000 + a, None, "bad")]
    posts, given = make(spark, [(*r, "p", "q") for r in rows], POSTS + ", Plain_Text string, kind string")
    got = {(r.post_id, r.kind, r.start_at) for r in P.found(posts, given).collect()}
    assert got == {(2, "phone", 4), (None, "phone", 4), (4, "phone", 400_004)}


def test_empty(spark):
    posts, given = make(spark, [])
    assert P.found(posts, given).count() == 0


def test_redacted(spark):
    posts, given = make(spark, [(1, "tel +44 1632 960136 ok", '<p>tel <a href="tel:+44 1632 960136">+44 1632 960136</a> ok</p>', "2024-01-01T00:00:00Z"), (2, None, "<b>plain</b>", None)])
    got = {r.post_id: r for r in P.redacted(posts, given).collect()}
    assert got[1].plain_text == "tel [PHONE] ok" and got[1].cooked == '<p>tel <a href="tel:[PHONE]">[PHONE]</a> ok</p>' and got[1].spans == 3
    assert got[2].plain_text is None and got[2].cooked == "<b>plain</b>" and got[2].spans == 0


def test_weights_favour_agreement():
    import pandas as pd

    rows = [((1, 1, 0, 0, 0, 0, 0), 60), ((1, 0, 0, 0, 0, 0, 0), 30), ((0, 0, -1, 0, -1, 0, -1), 50), ((0, 0, 0, 0, -1, 0, -1), 20)]
    p = P.weigh(pd.DataFrame([("phone", list(v), n) for v, n in rows], columns=["kind", "votes", "n"]))
    assert p["phone", rows[0][0]] > 0.95 and p["phone", rows[1][0]] > 0.8 and p["phone", rows[2][0]] < 0.05 and p["phone", rows[3][0]] < 0.2


def test_weights_are_alike_at_every_size():
    import pandas as pd

    rows = [((1, 1, 0, 0, 0, 0, 0), 298), ((1, 1, 0, 1, 0, 0, 0), 128), ((1, 0, -1, 1, 0, 0, 0), 86), ((1, 0, 0, 1, 0, 0, 0), 48), ((1, 0, 0, 0, 0, 0, 0), 41), ((1, 0, 0, 1, -1, 0, 0), 24), ((0, 0, 0, 0, 0, 0, 0), 10), ((0, 0, -1, 1, 0, 0, 0), 4)]
    for times in (1, 10, 1000):
        p = P.weigh(pd.DataFrame([("identity", list(v), n * times) for v, n in rows], columns=["kind", "votes", "n"]))
        assert min(p.values()) > 0.5, times


def spans_of(text, html=False, given=frozenset({"bo", "anna"})):
    return [(s.kind, text[s.start : s.end]) for s in (P.scan_html if html else P.scan)(text, given)]


def test_attributes_of_any_length_and_quoting():
    assert ("name", "Bo Li") in spans_of('<img alt="Bo Li">', True) and ("name", "Bo Li") in spans_of("<p>Bo Li wrote</p>", True)
    assert spans_of("<a href=mailto:anna@example.com>", True) == [("email", "anna@example.com")]
    assert spans_of('<b class="x" data-post="a@example.org" title="b@example.org">', True) == [("email", "a@example.org"), ("email", "b@example.org")]
    assert spans_of('<b data-username="anna@example.com">', True) == []


def test_windows_have_no_end():
    long = "a" * 90 + "." + "b" * 300 + "@example.com"
    assert spans_of("write to " + long) == [("email", long)]
    street = "Avenida de la " + "Maravillosisimamente" * 5 + " Grandisima 12"
    assert ("address", street) in spans_of("vivo en " + street + ".")
    name = "von der " + "Hohenlohe" * 10 + "-" + "Waldenburg" * 4 + ", Anna"
    assert ("name", name) in spans_of("signed " + name + " today")
    assert P._Context("mine " + "x" * 200 + " b c").before(209) == ["c", "b", "x" * 200, "mine"]


def test_at_in_any_brackets():
    for at in ("{at}", "[AT]", "(AT)", "[At]", "( at )", "<at>"):
        assert spans_of(f"jane.doe {at} mail.example")[0] == ("email", f"jane.doe {at} mail.example"), at


def test_names_in_other_letters():
    assert spans_of("signed Anna Иванова and went") == [("name", "Anna Иванова")]
