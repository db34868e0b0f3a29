from recordloom.llm.pii import personal_spans, redacted

GIVEN = ["Tamsin", "Mateo", "Robert", "Ingrid"]


def run(spark, texts, names=None):
    t = spark.createDataFrame([("m", i, "content", x, "e") for i, x in enumerate(texts)], "table_name string, row_id bigint, field_name string, text string, pii_type string")
    n = spark.createDataFrame([(x,) for x in (names if names is not None else [f"{g} Vardo{k}lin" for g in GIVEN for k in "abcde"] + [None])], "name string")
    spans = personal_spans(t, n)
    found = {}
    for r in spans.collect():
        found.setdefault(r.row_id, set()).add(r.pii_type)
    return found, {r.row_id: r.text for r in redacted(t, spans).collect()}


def test_types_decoys_and_discovery(spark):
    base = [f"Spoke with {g} Olster about this." for g in GIVEN * 3] + [f"My number is +99960{k}0012345." for k in range(9)] + ["Strip batch 3179275787."] * 3
    cases = {
        "Write to jo_x@mail.example.": {"EMAIL"}, "Write to jo [at] mail [dot] test please": {"EMAIL"}, "Call 00999 645 110 3591": {"PHONE"}, "My number is 6453 110 359.": {"PHONE"}, "The card says NID: 8238 8792 5532": {"ID_NUMBER"},
        "national ID 5918-1039-3371": {"ID_NUMBER"}, "MRN PT 00255 39810": {"ID_NUMBER"}, "Deliver to No. 32/B Candle Close.": {"ADDRESS"}, "Vive en Plaza de la Fuente, 141.": {"ADDRESS"}, "Wohnhaft Birkenweg 80.": {"ADDRESS"}, "Il habite 38 avenue de la Mare.": {"ADDRESS"},
        "Dr. Wennerin agreed.": {"NAME"}, "asked by tamsin orgle": {"NAME"}, "Spoke with Zelda Quorn about this.": {"NAME"}, "Lot 150968-1874 was used.": set(), "Strip batch 1530508505.": set(), "Blood pressure 142/98, dose 12.5 ml": set(),
        "The Larkfield Clinic desk has the form.": set(), "Tannery Road Practice called.": set(), "": set(), None: set(), "word " * 20000: set(), "1 " * 20000: set(),
    }
    texts = base + list(cases) + list(cases)[:3]
    found, clean = run(spark, texts)
    got = {t: found.get(len(base) + k, set()) for k, t in enumerate(cases)}
    assert got == cases
    k = len(base) + list(cases).index("Deliver to No. 32/B Candle Close.")
    assert clean[k] in ("Deliver to [ADDRESS].", "Deliver to [ADDRESS]")
    assert clean[len(base)].startswith("Write to [EMAIL]")


def test_empty(spark):
    assert run(spark, [], [])[0] == {}
    assert run(spark, ["Spoke with someone."], [])[0] == {}
