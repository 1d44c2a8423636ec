import pytest

from braidlake.llm.pii import Scanner, mask_pii, pii_items

CASES = [
    ("Reply to Ursula K. Bimivogis via ana.b+c[at]mail[dot]example please", [("NAME", "Ursula K. Bimivogis"), ("EMAIL", "ana.b+c[at]mail[dot]example")]),
    ("mail x_y @ lab.example.org, (617) 555-0181.", [("EMAIL", "x_y @ lab.example.org"), ("PHONE", "(617) 555-0181")]),
    ("tel +49 (0)30 23125-054 or 01632 960977", [("PHONE", "+49 (0)30 23125-054"), ("PHONE", "01632 960977")]),
    ("my id is 000.838.566-09 and QQ 55 66 74 C, 987-65-4321", [("ID_NUMBER", "000.838.566-09"), ("ID_NUMBER", "QQ 55 66 74 C"), ("ID_NUMBER", "987-65-4321")]),
    ("Ship to 12 West Bolofad Drive, Unit 4.", [("ADDRESS", "12 West Bolofad Drive")]),
    ("Ship to Calle Bolofad 229, 00604 or Kivuhumgasse 35a, or 51 bis rue de Sushel.", [("ADDRESS", "Calle Bolofad 229"), ("ADDRESS", "Kivuhumgasse 35a"), ("ADDRESS", "51 bis rue de Sushel")]),
    ("Please send the scan to Sijivumon, Ruth before noon", [("NAME", "Sijivumon, Ruth")]),
    ("belongs to GEPIBUVID Irena How is it", [("NAME", "GEPIBUVID Irena")]),
    ("Ask @graphbot. Ticket KG-3749816, ISBN 000-0-00-5784154, 2024-11-03, 12:47:09, build 3.14.2, chunk 259-7832", []),
    ("In 1985, Old Carrow Road met Victoria Basin and Martin Peak in front of Lake Clara.", []),
    ("", []),
    ("Dr. noor dopabosen asked; tell hugo kolemajun, and the diver, mei tevohomin, left. Signed: svetlana petrova\nmax speed will rise.", [("NAME", "noor dopabosen"), ("NAME", "hugo kolemajun"), ("NAME", "mei tevohomin"), ("NAME", "svetlana petrova")]),
    ("Pay DE89 3704 0044 0532 0130 00 or 4111 1111 1111 1111, not DE88 3704 0044 0532 0130 00.", [("ACCOUNT", "DE89 3704 0044 0532 0130 00"), ("ACCOUNT", "4111 1111 1111 1111")]),
    ("ssn 000-00-0000, passport no. ab1234567, dni: 12 345 678 Z; see https://user@host.example/a", [("ID_NUMBER", "ab1234567"), ("ID_NUMBER", "12 345 678")]),
]
# Names outside every list, and capitalised words that are none.
HELD_OUT = [
    "Please contact {} about the lease.", "I spoke with {} yesterday.", "{} said it was fine.", "The report by {} is late.", "We met {} and left.", "{} lives next door.", "my neighbour {} called.", "Thanks to {} it worked.", "This is {}'s bag.", "Ask Dr {} for it.", "{} was there.",
]
PEOPLE = ["Svetlana Petrova", "Nadeem Qureshi", "Giulia Rossi", "Rajesh Kumar", "Fiona Gallagher", "Aoife O'Brien", "Mehmet Yılmaz", "Łukasz Wójcik", "Ngozi Okafor", "Jean-Luc Moreau"]
NO_PEOPLE = ["We drove to Lake Superior and saw Tower Bridge.", "It was sent by Northfield College to Oxford Street Station.", "The Old Harbour was closed.", "Dinner with Victoria Sponge Company is on.", "We flew from Buenos Aires to Hong Kong.", "Open it with Google Maps or Microsoft Word.", "It is a Golden Retriever by Machine Learning.", "Das ist für Frau Müller.", "Gegen Mitternacht verließ der Gärtner mit Der Müller das Haus."]


def test_cases():
    scan = Scanner()
    for text, wanted in CASES:
        assert [(k, text[s:e]) for k, s, e in scan.items(text)] == wanted, text


def test_masking_keeps_the_rest():
    scan = Scanner()
    assert scan.masked("To a@b.example: hi") == "To [EMAIL]: hi"
    assert scan.masked(None) is None and scan.masked("  ") == "  "


def test_long_text_offsets_are_code_points():
    filler = "𝒳 é plain words. " * 20_000
    text = filler + "mail z@mail.example now"
    assert Scanner().items(text) == [("EMAIL", len(filler) + 5, len(filler) + 19)]


def test_tables(spark):
    rows = [(1, "a@b.example", "x"), (1, "a@b.example", "x"), (2, None, "y"), (None, "c@d.example", None), (3, "", "z")]
    df = spark.createDataFrame(rows, "id bigint, content string, pii_type string")
    got = {tuple(r) for r in pii_items(df, "id", "content", "t").collect()}
    assert got == {("t", 1, "EMAIL", 0, 11), ("t", None, "EMAIL", 0, 11)}
    assert pii_items(df.limit(0), "id", "content", "t").count() == 0
    masked = mask_pii(df, "content", "masked").collect()
    assert sorted(str(r["masked"]) for r in masked) == ["", "None", "[EMAIL]", "[EMAIL]", "[EMAIL]"]


def test_names_outside_the_lists():
    scan, found = Scanner(), 0
    for frame in HELD_OUT:
        for name in PEOPLE:
            text = frame.format(name)
            found += ("NAME", text.index(name), text.index(name) + len(name)) in scan.items(text)
    assert found >= 0.9 * len(HELD_OUT) * len(PEOPLE)
    assert [scan.items(t) for t in NO_PEOPLE] == [[]] * len(NO_PEOPLE)


def test_many_items_in_one_text():
    import time

    text = "mail a.b@c.example now; " * 16_000
    began = time.time()
    assert len(Scanner().items(text)) == 16_000 and time.time() - began < 5


def test_a_vocabulary_that_cannot_be_read_is_an_error(tmp_path):
    with pytest.raises(FileNotFoundError):
        Scanner(str(tmp_path / "none.tiktoken"))
    (tmp_path / "empty.tiktoken").touch()
    with pytest.raises(ValueError, match="no words"):
        Scanner(str(tmp_path / "empty.tiktoken"))
