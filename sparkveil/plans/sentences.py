"""Sentences of calls, each with what must be found in it, for every finder and rule of the span engine.

A case is a text and its spans. Texts and values are templates whose fields are made from a customer's
key, in expressions that Spark and the SQL engine share, so each case has as many rows as customers
fall to it. The expected spans are stated, not computed: type, value, confidence, ownership and, where
the value is read from another form, its canonical form.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.operators import privacy
from sparkveil.plans import transcripts as T
from sparkveil.plans.register import query
from sparkveil.session import spread, table

_PICK = "CASE c_custkey % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{}' WHEN 2 THEN '{}' ELSE '{}' END"
#: Fields of templates.
FIELDS = {
    "k": "cast(c_custkey as varchar(12))",
    "phone": T.PHONE,
    "other": T.OTHER,
    "pan": "concat('ABCPK', lpad(cast(c_custkey % 10000 as varchar(4)), 4, '0'), 'F')",
    "six": "lpad(cast(c_custkey % 1000000 as varchar(6)), 6, '0')",
    "ifsc": "concat('HDFC0', lpad(cast(c_custkey % 1000000 as varchar(6)), 6, '0'))",
    "d3": "cast(100 + c_custkey % 900 as varchar(3))",
    "d4": "cast(1000 + c_custkey % 9000 as varchar(4))",
    "d6": "cast(100000 + c_custkey % 900000 as varchar(6))",
    "pin": "cast(110000 + c_custkey % 800000 as varchar(6))",
    "account": "cast(30000000000 + c_custkey as varchar(11))",
    "passport": "concat('K', cast(1000000 + c_custkey % 9000000 as varchar(7)))",
    "voter": "concat('ABC', cast(1000000 + c_custkey % 9000000 as varchar(7)))",
    "licence": "concat('MH122011', lpad(cast(c_custkey % 10000000 as varchar(7)), 7, '0'))",
    "day": "cast(10 + c_custkey % 19 as varchar(2))",
    "card": _PICK.format("4111111111111111", "5555555555554444", "4012888888881881", "378282246310005"),
    "aadhaar": _PICK.format("234123412346", "499118665246", "255568721030", "367598342128"),
    "first": _PICK.format("Asha", "Ravi", "Meena", "Vikram"),
}


def made(template: str) -> str:
    """The SQL of a template, ``My PAN is {pan}.``."""
    parts = [FIELDS[p[1:-1]] if p.startswith("{") else "'" + p.replace("'", "''") + "'" for p in re.split(r"(\{\w+\})", template) if p]
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


#: (type, value, confidence, ownership[, canonical])
Expected = tuple
Case = tuple[str, list[Expected]]

# Types by shape and context.
IDENTIFIERS: list[Case] = [
    ("My email is user{k}@mailbox.in.", [("EMAIL", "user{k}@mailbox.in", 0.995, 4)]),
    ("Write to the desk on user{k}@mailbox.in today.", [("EMAIL", "user{k}@mailbox.in", 0.995, 0)]),
    ("My PAN is {pan}.", [("PAN", "{pan}", 0.995, 4)]),
    ("PAN number {pan} was noted.", [("PAN", "{pan}", 0.995, 3)]),
    ("The code {pan} appears here.", []),
    ("My UPI ID is name{k}@okaxis.", [("UPI", "name{k}@okaxis", 0.985, 4)]),
    ("Pay on vpa name{k}@somebank now.", [("UPI", "name{k}@somebank", 0.93, 3)]),
    ("Write name{k}@somebank now.", []),
    ("The visa card {card} was used.", [("CARD", "{card}", 0.995, 3)]),
    ("The payment used {card} yesterday.", [("CARD", "{card}", 0.88, 0)]),
    ("The payment used 4111111111111112 yesterday.", []),
    ("Aadhaar on file: {aadhaar}.", [("AADHAAR", "{aadhaar}", 0.995, 3)]),
    ("My Aadhaar number is 2345 6789 0123.", [("AADHAAR", "2345 6789 0123", 0.91, 4)]),
    ("The record 2345 6789 0123 is closed.", []),
    ("Reach {first} at {phone} please.", [("PHONE", "{phone}", 0.985, 3)]),
    ("The helpline number is {phone}.", []),
    ("I noted {phone} somewhere.", []),
    ("I noted 98765 4{d4} somewhere.", [("PHONE", "98765 4{d4}", 0.83, 0)]),
    ("My loan account number is {account}.", [("ACCOUNT_NUMBER", "{account}", 0.95, 4)]),
    ("The bank details {account} were read.", []),
    ("The verification code is {d6}.", [("OTP", "{d6}", 0.97, 3)]),
    ("Please login with {d6} now.", []),
    ("The card security code is {d3}.", [("CVV", "{d3}", 0.97, 3)]),
    ("The postal code {pin} was given.", [("PINCODE", "{pin}", 0.94, 3)]),
    ("We live near {pin} now.", []),
    ("My date of birth is {day}-03-1990.", [("DOB", "{day}-03-1990", 0.96, 4)]),
    ("The report was filed on {day}-03-1990.", []),
    ("My date of birth is {day} March 1990.", [("DOB", "{day} March 1990", 0.96, 4, "concat('1990-03-', {day})")]),
    ("He was born on March {day}, 1998 in Pune.", [("DOB", "March {day}, 1998", 0.96, 3, "concat('1998-03-', {day})")]),
    ("She was born on February 30, 1998 in Pune.", []),
    ("Passport {passport} was checked.", [("PASSPORT", "{passport}", 0.97, 3)]),
    ("The shelf {passport} was checked.", []),
    ("Voter ID {voter} was shown.", [("VOTER_ID", "{voter}", 0.96, 3)]),
    ("Driving licence {licence} was shown.", [("DRIVING_LICENSE", "{licence}", 0.96, 3)]),
    ("The branch lists {ifsc} here.", [("IFSC", "{ifsc}", 0.91, 0, "{ifsc}")]),
    ("Use ifsc HDFC zero {six} today.", [("IFSC", "HDFC zero {six}", 0.995, 3, "concat('HDFC0', {six})")]),
    ("The note says HDFC zero {six} today.", []),
]

# Names, addresses and partial identifiers.
PEOPLE: list[Case] = [
    ("My name is {first} Rao.", [("NAME", "{first} Rao", 0.94, 4)]),
    ("Customer name is {first} Kumar and the order is late.", [("NAME", "{first} Kumar", 0.94, 4)]),
    ("My name is not available.", []),
    ("I am {first} Rao.", [("NAME", "{first} Rao", 0.91, 4)]),
    ("I am {first}.", []),
    ("I am very happy.", []),
    ("My name is {first} Rao, Meera Rao.", [("NAME", "{first} Rao", 0.94, 4), ("NAME", "Meera Rao", 0.94, 4)]),
    ("My address is Flat {d3}, Green Road, Pune {pin}.", [("ADDRESS", "Flat {d3}, Green Road, Pune {pin}", 0.975, 4)]),
    ("The registered address is Flat {d3}, Green Road.", [("ADDRESS", "Flat {d3}, Green Road", 0.975, 3)]),
    ("The address is unknown.", []),
    ("I live at {day} Lake Road, Pune.", [("ADDRESS", "{day} Lake Road, Pune", 0.83, 3)]),
    ("I live at the seaside.", []),
    ("Please deliver the parcel to {day} Lake Road, Pune {pin}.", [("ADDRESS", "{day} Lake Road, Pune {pin}", 0.94, 3)]),
    ("Please deliver the parcel to the office.", []),
    ("My card ends with {d4}.", [("CARD", "{d4}", 0.995, 4)]),
    ("The last four digits of my account are {d4}.", [("ACCOUNT_NUMBER", "{d4}", 0.995, 4)]),
    ("The order ends with {d4}.", []),
]

# Credentials.
SECRETS: list[Case] = [
    ("The password is Tr0ub4dor{k}.", [("PASSWORD", "Tr0ub4dor{k}", 0.99, 4)]),
    ("In the documentation the password is Tr0ub4dor{k}.", []),
    ("The password is changeme.", []),
    ("The username is asha{k}.", [("USERNAME", "asha{k}", 0.99, 4)]),
    ("The username is required.", []),
    ("The api key is sk-live{d6}abcdEFGH.", [("API_KEY", "sk-live{d6}abcdEFGH", 0.99, 4)]),
    ("The api key is short{d3}.", []),
    ("The access token = Ab9-{d6}-xYz-77aaQ now.", [("AUTH_TOKEN", "Ab9-{d6}-xYz-77aaQ", 0.99, 4)]),
    ("Please use the token Ab9-{d6}-xYz-77aaQ now.", [("AUTH_TOKEN", "Ab9-{d6}-xYz-77aaQ", 0.99, 4)]),
    ("Please use the token abcdefghijklmnop now.", []),
    ("SERVICE_API_KEY=ghp_{d6}abcdefgh", [("API_KEY", "ghp_{d6}abcdefgh", 0.99, 4)]),
    ("DB_PASSWORD=hunter2{d6}", [("PASSWORD", "hunter2{d6}", 0.99, 4)]),
    ("The sample sets SERVICE_TOKEN=ghp_{d6}abcdefgh", []),
]

# Values that their owner names but that no shape fits, and the limits of their spans.
DAMAGED: list[Case] = [
    ("My phone is 9876 {d4}.", [("PHONE", "9876 {d4}", 0.94, 4)]),
    ("My phone number is {phone}.", [("PHONE", "{phone}", 0.94, 4)]),
    ("My card number is 4111 1111 {d3}.", [("CARD", "4111 1111 {d3}", 0.945, 4)]),
    ("My card number is {card}.", [("CARD", "{card}", 0.945, 4)]),
    ("A sample card number is 4111 1111 {d3}.", []),
    ("My pin code is 56{d3}.", [("PINCODE", "56{d3}", 0.935, 4)]),
    ("My IFSC is H D F C 0 1 2 {d3}.", [("IFSC", "H D F C 0 1 2 {d3}", 0.925, 4)]),
    ("My bank IFSC is {ifsc}.", [("IFSC", "{ifsc}", 0.995, 4, "{ifsc}")]),
    ("My passport number is K12 34{d3}.", [("PASSPORT", "K12 34{d3}", 0.93, 4)]),
    ("My passport number is K12 34{d3} and my order is late.", [("PASSPORT", "K12 34{d3}", 0.93, 4)]),
    ("My driving licence number is MH 1234567{d3}.", [("DRIVING_LICENSE", "MH 1234567{d3}", 0.93, 4)]),
    ("My IFSC code is hotel delta foxtrot. Charlie zero one two three four.", [("IFSC", "hotel delta foxtrot. Charlie zero one two three four", 0.935, 4)]),
    ("My email is asha{k} at mailbox.in please.", [("EMAIL", "asha{k} at mailbox.in", 0.975, 4, "concat('asha', {k}, '@mailbox.in')")]),
    ("My UPI is asha{k} at okaxis please.", [("UPI", "asha{k} at okaxis", 0.975, 4, "concat('asha', {k}, '@okaxis')")]),
    ("Meet asha{k} at mailbox.in please.", []),
]

# Answers to the sentence before.
ANSWERS: list[Case] = [
    ("Please share your PAN number. Mine is {pan}.", [("PAN", "{pan}", 0.985, 4)]),
    # A sentence ends at any full stop, so the answer's address is cut and only its shape remains.
    ("What is your email? It is user{k}@mailbox.in.", [("EMAIL", "user{k}@mailbox.in", 0.995, 0)]),
    ("Tell me your mobile number. I have {phone}.", [("PHONE", "{phone}", 0.97, 4)]),
    ("Please enter your Aadhaar number. Mine is {aadhaar}.", [("AADHAAR", "{aadhaar}", 0.97, 4)]),
    ("Please enter your Aadhaar number. Let me check. Mine is 4567 8901 2345.", []),
    ("Share the UPI ID please. It is name{k}@okaxis.", [("UPI", "name{k}@okaxis", 0.975, 4)]),
    ("What is the IFSC code? The code is {ifsc}.", [("IFSC", "{ifsc}", 0.985, 4, "{ifsc}")]),
    ("Read the OTP. I received {d6}.", [("OTP", "{d6}", 0.97, 4)]),
    ("Read the CVV. I received {d3}.", [("CVV", "{d3}", 0.97, 4)]),
    ("Read the CVV. I received {d3} calls.", []),
    ("Give the account number. The number is {account}.", [("ACCOUNT_NUMBER", "{account}", 0.97, 4)]),
    ("The pin code please. Mine is {pin}.", [("PINCODE", "{pin}", 0.96, 4)]),
    ("What is your date of birth? It is {day} March 1990.", [("DOB", "{day} March 1990", 0.97, 4, "concat('1990-03-', {day})")]),
    ("The passport please. Mine is {passport}.", [("PASSPORT", "{passport}", 0.97, 4)]),
    ("Show the driving licence. The number is {licence}.", [("DRIVING_LICENSE", "{licence}", 0.97, 4)]),
    ("The voter id please. It is {voter}.", [("VOTER_ID", "{voter}", 0.97, 4)]),
    ("The credit card please. It is {card}.", [("CARD", "{card}", 0.985, 4)]),
    ("What is your address? It is Flat {d3}, Green Road, Pune.", [("ADDRESS", "Flat {d3}, Green Road, Pune", 0.96, 4)]),
    ("Read the OTP. That was {d6}.", []),
]

# Spoken values.
SPOKEN: list[Case] = [
    ("My PAN is alpha bravo charlie delta echo one two three four foxtrot.", [("PAN", "alpha bravo charlie delta echo one two three four foxtrot", 0.96, 4, "'ABCDE1234F'")]),
    ("My passport is kilo one two three four five six seven.", [("PASSPORT", "kilo one two three four five six seven", 0.96, 4, "'K1234567'")]),
    ("The word alpha bravo charlie was heard.", []),
    ("My email is {first} dot rao at mailbox dot co dot in.", [("EMAIL", "{first} dot rao at mailbox dot co dot in", 0.95, 4, "concat(lower({first}), '.rao@mailbox.co.in')")]),
    ("My UPI is {first} dot rao at okaxis.", [("UPI", "{first} dot rao at okaxis", 0.96, 4, "concat(lower({first}), '.rao@okaxis')")]),
    ("My date of birth is twenty-first January two thousand two.", [("DOB", "twenty-first January two thousand two", 0.96, 4, "'2002-01-21'")]),
    ("The meeting is on twenty-first January two thousand two.", []),
    ("My driving licence number is Maharashtra one two two zero one one zero one two three four five six.", [("DRIVING_LICENSE", "Maharashtra one two two zero one one zero one two three four five six", 0.96, 4, "'MH1220110123456'")]),
    ("My mobile number is nine eight seven six five four three two one zero.", [("PHONE", "nine eight seven six five four three two one zero", 0.95, 4, "'9876543210'")]),
    ("Call me on plus nine one nine eight seven six five four three two one zero.", [("PHONE", "plus nine one nine eight seven six five four three two one zero", 0.95, 4, "'919876543210'")]),
    ("My account number is double one two three four five six seven eight nine.", [("ACCOUNT_NUMBER", "double one two three four five six seven eight nine", 0.94, 4, "'1123456789'")]),
    ("My OTP is four five six seven eight nine.", [("OTP", "four five six seven eight nine", 0.96, 4, "'456789'")]),
    ("My CVV is four five six.", [("CVV", "four five six", 0.96, 4, "'456'")]),
    ("My pin code is five six triple zero one.", [("PINCODE", "five six triple zero one", 0.93, 4, "'560001'")]),
    ("My card number is four one one one one one one one one one one one one one one one.", [("CARD", "four one one one one one one one one one one one one one one one", 0.98, 4, "'4111111111111111'")]),
    ("My Aadhaar is two three four one two three four one two three four six.", [("AADHAAR", "two three four one two three four one two three four six", 0.94, 4, "'234123412346'")]),
    ("My IFSC is HDFC zero zero zero one two three four.", [("IFSC", "HDFC zero zero zero one two three four", 0.96, 4, "'HDFC0001234'")]),
    ("We counted one two three four five six people.", []),
]

# Vetoes, their exceptions, lists and repairs.
CONTEXTS: list[Case] = [
    ("The documentation shows the email test{k}@mailbox.in as text.", []),
    ("My email test{k}@mailbox.in is in the manual.", [("EMAIL", "test{k}@mailbox.in", 0.995, 4)]),
    ("A PAN can be written as {pan}.", []),
    ("The district uses the pin code {pin}.", []),
    ("The tracking id user{k}@mailbox.in was used.", []),
    ("The order number is {phone}, my mobile is {other}.", [("PHONE", "{other}", 0.94, 4)]),
    ("My mobile numbers are {phone} and {other}.", [("PHONE", "{phone}", 0.985, 4), ("PHONE", "{other}", 0.985, 4)]),
    # Full stops cut the context of the second value: only timing brings it back.
    ("My OTP is {d6}... 638292.", [("OTP", "{d6}", 0.97, 4)]),
    ("My OTP is {d6}, wait, 638292.", [("OTP", "638292", 0.97, 4)]),
    ("My OTP is {d6} or 638292.", [("OTP", "{d6}", 0.97, 4), ("OTP", "638292", 0.97, 4)]),
    ("My account number is {account} and my IFSC is {ifsc}.", [("ACCOUNT_NUMBER", "{account}", 0.95, 4), ("IFSC", "{ifsc}", 0.995, 4, "{ifsc}")]),
    ("My account is {account}. My card number is {card}.", [("ACCOUNT_NUMBER", "{account}", 0.95, 4), ("CARD", "{card}", 0.945, 4)]),
]

GROUPS = {"identifier_spans": IDENTIFIERS, "people_spans": PEOPLE, "secret_spans": SECRETS, "damaged_spans": DAMAGED, "answer_spans": ANSWERS, "spoken_spans": SPOKEN, "context_spans": CONTEXTS}


def by_key(cases: list[Case]) -> str:
    """The text of a customer: cases take turns by key."""
    return f"CASE c_custkey % {len(cases)} " + " ".join(f"WHEN {i} THEN {made(text)}" for i, (text, _) in enumerate(cases)) + " END"


def expected_sql(cases: list[Case]) -> str:
    """What the cases must give: call_id, type, value, confidence, ownership, canonical."""
    rows = []
    for i, (_, spans) in enumerate(cases):
        for kind, value, confidence, ownership, *canonical in spans:
            form = re.sub(r"\{(\w+)\}", lambda m: FIELDS[m[1]], canonical[0]) if canonical else "CAST(NULL AS VARCHAR)"
            rows.append(f"SELECT c_custkey AS call_id, '{kind}' AS type, {made(value)} AS value, {confidence}::DOUBLE AS confidence, {ownership}::INT AS ownership, {form} AS canonical FROM customer WHERE c_custkey % {len(cases)} = {i}")
    return "\nUNION ALL ".join(rows)


def said(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``call_id, text``, one text for each customer."""
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("call_id"), F.expr(text).alias("text"))


def _register(name: str, cases: list[Case]) -> None:
    @query(expected_sql(cases), name)
    def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = privacy.detect(said(spark, sf_dir, by_key(cases))).select("call_id", F.explode(privacy.stated(F.col("pii"))).alias("s"))
        return found.select("call_id", "s.type", "s.value", "s.confidence", "s.ownership", "s.canonical")


for _name, _cases in GROUPS.items():
    _register(_name, _cases)


# ---- profanity and operational identifiers: word or value, and what it is ----

RUDE = [
    ("fuck", "fuck", 3, 0.99), ("fvck", None, 0, 0), ("f**k", "fuck", 3, 0.94), ("sh1t", "shit", 2, 0.95), ("s h i t", "shit", 2, 0.94), ("bullshit", "shit", 2, 0.99), ("b!tch", "bitch", 3, 0.95), ("b**h", "bitch", 3, 0.94),
    ("bastards", "bastard", 2, 0.99), ("a$$hole", "asshole", 3, 0.95), ("asset", None, 0, 0), ("madar  chod", "madarchod", 3, 0.95), ("madar chod", "madarchod", 3, 0.99), ("bhenchod", "bhenchod", 3, 0.99), ("chutiye", "chutiya", 3, 0.99),
    ("har4mi", "harami", 2, 0.95), ("gandu", "gandu", 3, 0.99), ("b4kch0di", "bakchod", 2, 0.95), ("class", None, 0, 0), ("m.o.t.h.e.r.f.u.c.k.e.r", "fuck", 3, 0.95),
]
_RUDE_SQL = "\nUNION ALL ".join(f"SELECT c_custkey AS call_id, '{word}' AS value, '{name}' AS canonical, {severity}::INT AS severity, {confidence}::DOUBLE AS confidence FROM customer WHERE c_custkey % {len(RUDE)} = {i}" for i, (word, name, severity, confidence) in enumerate(RUDE) if name)


@query(_RUDE_SQL)
def rude_words(spark, sf_dir):
    """Profanity as it stands, with look-alike letters, censored and spaced, and clean look-alikes."""
    text = f"CASE c_custkey % {len(RUDE)} " + " ".join(f"WHEN {i} THEN 'Oh {word} again.'" for i, (word, *_) in enumerate(RUDE)) + " END"
    rows = privacy.protect_documents(said(spark, sf_dir, text)).select("call_id", F.explode("protected.profanity").alias("s"))
    return rows.select("call_id", "s.value", "s.canonical", "s.severity", "s.confidence")


IDS: list[tuple[str, list[tuple[str, str, float]]]] = [
    ("The transaction id is TXN{d6}.", [("TRANSACTION_ID", "TXN{d6}", 0.96)]),
    ("Txn ref: AB-{d6}/x, thanks.", [("TRANSACTION_ID", "AB-{d6}/x", 0.96)]),
    ("The loan number {d6} is open.", [("LOAN_ID", "{d6}", 0.96)]),
    ("Customer id = C{d6}", [("CUSTOMER_ID", "C{d6}", 0.95)]),
    ("The application number is APP{d6}.", [("APPLICATION_ID", "APP{d6}", 0.94)]),
    ("Ticket no. T-{d6} and case id is CASE{d6}.", [("COMPLAINT_ID", "T-{d6}", 0.93), ("COMPLAINT_ID", "CASE{d6}", 0.93)]),
    ("The ticket number is pending.", []),
    ("The customer number is 12345.", []),
    ("The invoice says {d6}.", []),
]
_IDS_SQL = "\nUNION ALL ".join(f"SELECT c_custkey AS call_id, '{kind}' AS type, {made(value)} AS value, {confidence}::DOUBLE AS confidence FROM customer WHERE c_custkey % {len(IDS)} = {i}" for i, (_, spans) in enumerate(IDS) for kind, value, confidence in spans)


@query(_IDS_SQL)
def operational_identifiers(spark, sf_dir):
    rows = privacy.protect_documents(said(spark, sf_dir, by_key(IDS)), ids=True).select("call_id", F.explode("protected.financial_ids").alias("s"))
    return rows.select("call_id", "s.type", "s.value", "s.confidence")


# ---- protection: masks, types, profiles, public metadata ----

_MASKED = [
    ("My phone number is {phone}.", "concat('My phone number is [PHONE ••••', right({phone}, 4), '].')"),
    ("My email is user{k}@mailbox.in.", "'My email is [EMAIL u***@mailbox.in].'"),
    ("My card ends with {d4}.", "'My card ends with [CARD REDACTED].'"),
    ("My OTP is {d6}.", "'My OTP is [OTP REDACTED].'"),
    ("The transaction id is TXN{d6}, what a sh1t day.", "'The transaction id is [TRANSACTION_ID REDACTED], what a [BLEEP] day.'"),
    ("My account number is {account}.", "concat('My account number is [ACCOUNT_NUMBER ••••', right({account}, 4), '].')"),
]
_fill = lambda sql: re.sub(r"\{(\w+)\}", lambda m: FIELDS[m[1]], sql)


@query(f"SELECT c_custkey AS call_id, CASE c_custkey % {len(_MASKED)} " + " ".join(f"WHEN {i} THEN {_fill(safe)}" for i, (_, safe) in enumerate(_MASKED)) + " END AS safe_text FROM customer")
def partial_masks(spark, sf_dir):
    """Partial masks keep a number's last four digits or a provider; partial identifiers stay hidden."""
    return privacy.protect_documents(said(spark, sf_dir, by_key(_MASKED)), mode="partial", ids=True).select("call_id", "protected.safe_text")


_TWO = "My email is user{k}@mailbox.in and my OTP is {d6}."


@query(f"SELECT c_custkey AS call_id, concat('My email is user', cast(c_custkey as varchar(12)), '@mailbox.in and my OTP is [OTP REDACTED].') AS safe_text, 1::BIGINT AS pii FROM customer")
def chosen_types(spark, sf_dir):
    """Only the types asked for are hidden."""
    rows = privacy.protect_documents(said(spark, sf_dir, made(_TWO)), types=frozenset(["OTP"]))
    return rows.select("call_id", "protected.safe_text", F.size("protected.pii").cast("long").alias("pii"))


_LEVELS = ["I noted 98765 4{d4} somewhere.", "The bank details {account} were read.", "I am {first} Rao.", "My email is user{k}@mailbox.in."]


@query("""SELECT c_custkey AS call_id, [0, 0, 0, 1][1 + c_custkey % 4]::BIGINT AS strict, [1, 0, 1, 1][1 + c_custkey % 4]::BIGINT AS balanced, [1, 1, 1, 1][1 + c_custkey % 4]::BIGINT AS generous FROM customer""")
def profiles(spark, sf_dir):
    """What each profile finds in values of .83, .73, .91 and .995."""
    rows = said(spark, sf_dir, by_key([(t, []) for t in _LEVELS]))
    for out, profile in (("strict", "high_precision"), ("balanced", "balanced"), ("generous", "high_recall")):
        rows = privacy.detect(rows, out="_" + out, profile=profile).withColumn(out, F.size("_" + out).cast("long"))
    return rows.select("call_id", "strict", "balanced", "generous")


@query(f"""WITH t AS (SELECT c_custkey AS call_id, {made(_TWO)} AS text FROM customer)
SELECT call_id, 'EMAIL' AS type, 12::INT AS start, (instr(text, ' and') - 1)::INT AS stop, '[EMAIL REDACTED]' AS masked_value, round((0.995 + 0.97) / 2, 6) AS mean_confidence FROM t
UNION ALL SELECT call_id, 'OTP', (instr(text, 'OTP is') + 6)::INT, (length(text) - 1)::INT, '[OTP REDACTED]', round((0.995 + 0.97) / 2, 6) FROM t""")
def public_metadata(spark, sf_dir):
    """Spans as they may be shown, without their values, and the mean confidence of a text."""
    rows = privacy.detect(said(spark, sf_dir, made(_TWO)))
    shown = rows.select("call_id", F.explode(privacy.public_spans(F.col("pii"))).alias("s"), F.round(privacy.mean_confidence(F.col("pii")), 6).alias("mean_confidence"))
    return shown.select("call_id", "s.type", "s.start", F.col("s.end").alias("stop"), "s.masked_value", "mean_confidence")
