"""Bundled schemas. Names, ends, attributes and symmetry are fixed values; definitions are short and our own."""

from __future__ import annotations

from .ontology import from_rows, relation

BUSINESS = from_rows(
    "business",
    ["Person: a human being", "Org: a company, authority, club or other organisation", "Object: a physical thing that is owned", "Place: a place on earth", "Coordinate: a numeric position", "Event: something that happened at some time"],
    [
        relation("EmployedBy", "Person", "Org", "works for it", attributes=("role", "start", "end")),
        relation("ExecutiveOf", "Person", "Org", "leads it as an executive", attributes=("title", "start", "end")),
        relation("BoardMemberOf", "Person", "Org", "sits on its board", attributes=("start", "end")),
        relation("MemberOf", "Person", "Org", "is a member of it", attributes=("start", "end"), aliases=("BELONGS_TO", "AFFILIATED_WITH", "MEMBERSHIP_IN")),
        relation("FamilyOf", "Person", "Person", "is a close relative", symmetric=True, attributes=("kind",), aliases=("RELATIVE_OF", "KIN_OF", "RELATED_TO")),
        relation("AssociateOf", "Person", "Person", "is called an associate", symmetric=True, aliases=("CLOSE_TO", "CONFIDANT_OF", "ACQUAINTED_WITH")),
        relation("MetWith", "Person", "Person", "met in person", symmetric=True, attributes=("date",), aliases=("MET", "MET_IN_PERSON", "HAD_MEETING_WITH")),
        relation("CommunicatedWith", "Person", "Person", "called, wrote to or messaged", symmetric=True, attributes=("date", "channel"), aliases=("CONTACTED", "CORRESPONDED_WITH", "SPOKE_WITH")),
        relation("LocatedIn", "Person|Org|Object|Place", "Place", "lives, is or lies there; a seat is HEADQUARTERED_IN", attributes=("start", "end"), aliases=("SITUATED_IN", "RESIDES_IN", "LIES_IN")),
        relation("BornIn", "Person", "Place", "was born there", attributes=("date",), aliases=("BIRTHPLACE", "BORN_AT", "NATIVE_OF")),
        relation("OperatesIn", "Org", "Place", "does business there", attributes=("start", "end"), aliases=("ACTIVE_IN", "OPERATES_AT", "DOES_BUSINESS_IN")),
        relation("HeadquarteredIn", "Org", "Place", "has its seat there", aliases=("BASED_IN", "HQ_IN", "SEATED_IN")),
        relation("Founded", "Person|Org", "Org", "founded it", attributes=("date",), aliases=("ESTABLISHED", "CREATED", "SET_UP")),
        relation("OwnsStakeIn", "Person|Org", "Org", "owns a part of it", attributes=("share", "start", "end"), aliases=("SHAREHOLDER_OF", "HOLDS_SHARES_IN", "STAKEHOLDER_IN")),
        relation("SubsidiaryOf", "Org", "Org", "is a unit or brand of it", attributes=("start", "end"), aliases=("DIVISION_OF", "UNIT_OF", "BRAND_OF")),
        relation("Acquired", "Person|Org", "Org", "bought it", attributes=("date",), aliases=("BOUGHT", "TOOK_OVER", "PURCHASED")),
        relation("HasCoordinate", "Place", "Coordinate", "lies at it", aliases=("AT_COORDINATE", "GEOLOCATED_AT", "LOCATED_AT_COORDINATE")),
        relation("OwnsObject", "Person|Org", "Object", "owns the thing", attributes=("start", "end"), aliases=("OWNS", "POSSESSES", "HOLDS_TITLE_TO")),
        relation("TransferredObject", "Event", "Object", "gave the thing to another", aliases=("HANDED_OVER", "DELIVERED", "CONVEYED")),
        relation("ParticipatedIn", "Person|Org", "Event", "took part in it", attributes=("role",), aliases=("TOOK_PART_IN", "ATTENDED", "INVOLVED_IN")),
        relation("HeldAt", "Event", "Place", "happened there", aliases=("TOOK_PLACE_AT", "OCCURRED_AT", "HAPPENED_AT")),
    ],
)
POLITICS = from_rows(
    "politics",
    ["Person", "Org", "Place", "Event", "Law"],
    [
        relation("MemberOfParty", "Person", "Org", attributes=("start", "end")),
        relation("HoldsOffice", "Person", "Org", attributes=("title", "start", "end")),
        relation("CandidateIn", "Person", "Event"),
        relation("WonElection", "Person|Org", "Event"),
        relation("Represents", "Person", "Place", attributes=("start", "end")),
        relation("Proposed", "Person|Org", "Law", attributes=("date",)),
        relation("Passed", "Org", "Law", attributes=("date",)),
        relation("GovernsIn", "Org", "Place", attributes=("start", "end")),
        relation("AlliedWith", "Org", "Org", symmetric=True, attributes=("start", "end")),
        relation("SucceededInOffice", "Person", "Person", attributes=("title", "date")),
    ],
)
LEGAL = from_rows(
    "legal",
    ["Person", "Org", "Place", "Charge", "Case"],
    [
        relation("ChargedWith", "Person|Org", "Charge", attributes=("date",)),
        relation("ConvictedOf", "Person|Org", "Charge", attributes=("date",)),
        relation("AcquittedOf", "Person|Org", "Charge", attributes=("date",)),
        relation("DefendantIn", "Person|Org", "Case"),
        relation("HeardBy", "Case", "Org"),
        relation("RepresentedBy", "Person|Org", "Person|Org", attributes=("case",)),
        relation("Investigated", "Org", "Person|Org", attributes=("date",)),
        relation("Sentenced", "Person|Org", "Person|Org", attributes=("term", "date")),
        relation("Victim", "Person|Org", "Case"),
    ],
)
SPORTS = from_rows(
    "sports",
    ["Person", "Org", "Place", "Event", "Work"],
    [
        relation("PlaysFor", "Person", "Org", attributes=("start", "end")),
        relation("Coaches", "Person", "Org", attributes=("start", "end")),
        relation("CompetedIn", "Person|Org", "Event"),
        relation("Won", "Person|Org", "Event"),
        relation("HeldIn", "Event", "Place"),
        relation("Authored", "Person", "Work", attributes=("date",)),
        relation("PerformedIn", "Person", "Work", attributes=("role",)),
        relation("BasedIn", "Org", "Place"),
        relation("TransferredTo", "Person", "Org", attributes=("date",)),
    ],
)
