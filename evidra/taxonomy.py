"""The taxonomy of the test data: carriers, promotions and issues as data. Any other can be passed in its place."""

from __future__ import annotations

#: Carriers in matching order: what texts call them, and what respondents of arbitration files are called.
CARRIERS = [
    ("norvane", ["norvane wireless", "norvane"]),
    ("tellumo", ["tellumo"]),
    ("kestrelcom", ["kestrelcom"]),
    ("quillmobile", ["quill mobile"]),
]
RESPONDENTS = [
    ("norvane", ["norvane wireless holdings"]),
    ("tellumo", ["tellumo communications"]),
    ("kestrelcom", ["kestrelcom mobility"]),
    ("quillmobile", ["quill mobile partnership"]),
]
PROMOTIONS = [("norvane", ["switch bonus 36", "trade up max"]), ("tellumo", ["zero down days"]), ("kestrelcom", ["forever upgrade"]), ("quillmobile", ["family five"])]
ISSUES = [
    ("trade_in_credit", ["trade-in credit"]), ("bill_credit", ["bill credit", "bill credits"]), ("promo_credit", ["promotional credit"]), ("clawback", ["clawed back", "clawback"]),
    ("activation_fee", ["activation fee"]), ("unlock", ["unlock request"]), ("installment", ["installment"]),
]
QUESTIONS = [
    (1, "How many clawback records name Tellumo?"), (2, "Has the trade-in credit of Norvane Wireless gotten worse?"), (3, "What happened to the promotional credit at the Lower Quay store?"),
    (4, "Which dealer denied the unlock request"), (5, "why was the activation fee miscounted after 9 months?"), (6, "number of Quill Mobile complaints"), (7, "is it"),
]
