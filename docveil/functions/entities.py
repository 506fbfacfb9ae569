"""Entity keys and what is fixed about them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stable keys, never translated.
CPR, CPR_LOOSE, PHONE, CVR = "DK_CPR", "DK_CPR_MULIG", "DK_PHONE", "DK_CVR"
ACCOUNT, ADDRESS, POSTAL, CASE_NO = "DK_ACCOUNT", "DK_ADDRESS", "DK_POSTAL_CITY", "DK_CASE_NO"
PERSON, LOCATION, ORGANIZATION = "PERSON", "LOCATION", "ORGANIZATION"
EMAIL, IBAN, CARD = "EMAIL_ADDRESS", "IBAN_CODE", "CREDIT_CARD"

#: Which of two spans of one length stays.
PRIORITY = (CPR, CPR_LOOSE, CVR, IBAN, CARD, ACCOUNT, PHONE, CASE_NO, EMAIL, ADDRESS, POSTAL, PERSON, ORGANIZATION, LOCATION)
#: The order of groups in a review.
REVIEW_ORDER = (CPR, CPR_LOOSE, CVR, EMAIL, IBAN, CARD, PHONE, ACCOUNT, PERSON, ADDRESS, POSTAL, CASE_NO, ORGANIZATION, LOCATION)
#: Entities whose key is their digits.
NUMERIC = (CPR, CPR_LOOSE, PHONE, CVR, ACCOUNT, CARD)

#: Stems of pseudonyms, and the labels of a review where they differ.
STEMS = {
    CPR: "CPR-nummer", CPR_LOOSE: "CPR-nummer", CVR: "CVR-nummer", PHONE: "Telefonnummer", ACCOUNT: "Kontonummer",
    ADDRESS: "Adresse", POSTAL: "Postnr-by", CASE_NO: "Sagsnummer", PERSON: "Person", LOCATION: "Sted",
    ORGANIZATION: "Organisation", EMAIL: "E-mail", IBAN: "IBAN", CARD: "Betalingskort",
}
REVIEW_LABELS = {**STEMS, CPR_LOOSE: "Muligt CPR-nummer"}


def _lookup(entity: Column, table: dict, default) -> Column:
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(known, entity), F.lit(default))


def priority(entity: Column) -> Column:
    return _lookup(entity, {e: k for k, e in enumerate(PRIORITY)}, len(PRIORITY))


def review_rank(entity: Column) -> Column:
    return _lookup(entity, {e: k for k, e in enumerate(REVIEW_ORDER)}, len(REVIEW_ORDER))


def entity_label(entity: Column) -> Column:
    return _lookup(entity, STEMS, "Oplysning")


def review_label(entity: Column) -> Column:
    return _lookup(entity, REVIEW_LABELS, "Oplysning")
