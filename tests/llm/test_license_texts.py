"""Licences known by their whole text, and what copyright lines leave behind."""

import re

from stratalign.llm import license_scan

NOTICE_ONLY = {"CC-BY-4.0", "CC-BY-NC-4.0"}


def test_licences_of_the_notices_are_known_by_whole_text(spark, docs_of):
    assert set(license_scan.NOTICES) - set(license_scan.TEXTS) == NOTICE_ONLY
    named = sorted(license_scan.TEXTS)
    # other spacing and case than the catalogue's
    rows = [(i, re.sub(r"[ ]+", "  ", license_scan.TEXTS[n]).upper(), "s") for i, n in enumerate(named)]
    bsd = license_scan.TEXTS["BSD-3-Clause"]
    holder = "Copyright (c) 2019, Some One\nAll rights reserved.\n\n"
    rows += [(100, holder + bsd.partition("\n")[2], "s"), (101, bsd.partition("\n")[2].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "s"), (102, bsd + "\nand more", "s")]
    rows += [(103, license_scan.TEXTS["Apache-2.0"].partition("APPENDIX")[0], "s")]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(docs_of(rows)).collect()}
    assert [got[i] for i in range(len(named))] == named
    assert [got[i] for i in range(100, 104)] == ["BSD-3-Clause", "BSD-3-Clause", None, "Apache-2.0"]


def test_only_the_claim_of_a_copyright_line_is_dropped(spark, docs_of):
    apache, mit = "Licensed under the Apache License, Version 2.0.", license_scan.TEXTS["MIT"]
    grant = mit.partition("holders>\n")[2]
    cases = {
        "Copyright 2021 Acme. " + apache: (1, "Apache-2.0"),
        "Copyright 2021 Acme Inc. " + apache: (1, "Apache-2.0"),
        "(c) 2020-2021 J. Doe, " + apache: (1, "Apache-2.0"),
        "MIT License\nCopyright (c) 2020 X " + grant: (4, "MIT"),
        "MIT License\nCopyright (c) 2020 X Ltd. All rights reserved. " + grant: (4, "MIT"),
        "Copyright law of 1976 protects authors.": (1, None),
        "Copyright 2019 Acme Inc. The prose goes on.": (1, None),
        "Copyright (c) 2019 J. Doe <j@x.org>": (0, None),
        "Copyright (C) 2007 Acme, Inc. <https://x.org/>": (0, None),
        "Copyright 2019 Acme Inc. and contributors": (0, None),
        "Copyright Acme Corp, 2019. All rights reserved.": (0, None),
        "Copyright Acme Inc. 2019": (0, None),
        "All rights reserved.": (0, None),
        "(c) 2020 " + "word " * 20_000 + "1999": (0, None),
        "Copyright " + "word " * 20_000 + "1999": (0, None),  # a holder's name may be of any length
        "Copyright " + "word " * 20_000 + "ends. 1999": (1, None),
    }
    rows = [(i, t, "s") for i, t in enumerate(cases)]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs_of(rows)).collect()}
    for i, t, _ in rows:
        assert (got[i]["n_lines"], got[i]["license"]) == cases[t], t[:80]
        assert got[i]["digest"] == license_scan.digest_of(t), t[:80]
    assert got[0]["notices"] == ["Apache-2.0"]


def test_whole_licences_inside_longer_documents(spark, docs_of):
    mit, isc, bsd = license_scan.TEXTS["MIT"], license_scan.TEXTS["ISC"], license_scan.TEXTS["BSD-2-Clause"]
    apache = license_scan.TEXTS["Apache-2.0"].replace("\n", "\n// ")
    cases = {
        "readme\n" + mit + "\nmore": "MIT", isc.upper() + "\n\n" + "MIT License " + mit: "ISC,MIT", mit[:-40]: "", "a\n" + apache + "\nb": "Apache-2.0",
        ("MIT License permission is hereby granted free of charge to any person " * 300) + mit: "MIT", "prose": "", "": "",
        "x" + bsd.partition("\n")[2]: "", "x " + bsd.partition("\n")[2]: "BSD-2-Clause", mit + "\n" + mit: "MIT", "word " * 30_000 + isc + " word" * 30_000: "ISC",
    }
    rows = [(i, t, "s") for i, t in enumerate(cases)]
    got = {r["doc_id"]: r["blocks"] for r in license_scan.scan_licenses(docs_of(rows)).collect()}
    for i, t, _ in rows:
        want = [n for n in sorted(license_scan.TEXTS) if any(f" {license_scan.canonical_text(f)} " in f" {license_scan.canonical_text(t)} " for f in license_scan.forms_of(n, license_scan.TEXTS[n]))]
        assert got[i] == want and ",".join(want) == cases[t], (t[:60], got[i], want)
