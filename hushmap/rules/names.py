"""Column-name rules. The first rule that matches a name decides, case aside."""

from __future__ import annotations

from dataclasses import dataclass

SENSITIVE = "Sensitive"
NON_SENSITIVE = "NonSensitive"


@dataclass(frozen=True)
class NameRule:
    rule: str
    tag: str
    regex: str


# Fixed values, in the order in which they are tried. The key of the passport rule is
# spelt as users of the rule list know it.
SENSITIVE_NAMES = [
    ("PASSWORD", r"^.*pass(word|_word|).*$"),
    ("SSN", r"^.*(ssn|social).*$"),
    ("CREDIT_CARD", r"^.*(credit).*(card).*$"),
    ("BANK_ACCOUNT", r"^.*bank.*(acc|num).*$"),
    ("EMAIL_ADDRESS", r"^.*(email|e-mail|mail).*$"),
    ("USER_NAME", r"^.*(user|client|person).*(name).*$"),
    (
        "PERSON",
        r"^.*(firstname|fname|lastname|lname|fullname|maidenname|_name|"
        r"nickname|name_suffix|name|person).*$",
    ),
    ("USERNAME", r"^.*user(id|name|_id|_name|).*$"),
    ("POBOX", r"^.*(po_box|pobox|postbox).*$"),
    (
        "PAYMENTCARD",
        r"^.*(credit_card|cc_number|cc_num|creditcard|"
        r"credit_card_num|creditcardnumber|card_number|cardnum).*$",
    ),
    ("AADHAAR", r"^.*(aadhaar|uidai|aadhaar_number|aadhaar_no).*$"),
    ("PAN", r"^.*(pan|pan_number|pan_no).*$"),
    ("VOTERID", r"^.*(voter_id|voterid|voter).*$"),
    ("DRIVERLICENSE", r"^.*(driver_license|license_no|dl_number|driving_license).*$"),
    ("PAASPORT", r"^.*(passport|passport_number|passport_no).*$"),
    ("IP_ADDRESS", r"^.*(ip_address|ipaddress|ipaddr|ip_addr|ip).*$"),
    ("MAC_ADDRESS", r"^.*(mac_address|macaddress|macaddr|mac_addr|mac).*$"),
    (
        "BANK_ACCOUNT_NUMBER",
        r"^.*(bank_account_number|bankaccountnumber|bank_acc_number|bank_acc_no|bank_account|"
        r"acct_number|acct_no|account_no|account_number|acc_no|acc_number).*$",
    ),
    ("IFSC", r"^.*(ifsc|ifsc_code|ifsc_number).*$"),
    (
        "RATION_CARD_NUMBER",
        r"^.*(ration_card_number|rationcardnumber|ration_card|rationcard|ration_no|"
        r"rationnumber|rationcard_no|rationcard_number).*$",
    ),
    (
        "VEHICLE_IDENTIFICATION_NUMBER",
        r"^.*(vehicle|vehicle_id|vehicle_id_number|vehicle_identification_number|"
        r"vehicle_number|vin|vin_number|veh_id|veh_identification|veh_number).*$",
    ),
    ("UPI_ID", r"^.*(upi_id|upiid|upi_id_number|upiidnumber|upi|upi_number).*$"),
    ("GST_NUMBER", r"^.*(gst_number|gstnumber|gst_no|gstno|gst).*$"),
]

NON_SENSITIVE_NAMES = [
    (
        "BIRTH_DATE",
        r"^.*(date_of_birth|dateofbirth|dob|"
        r"birthday|date_of_death|dateofdeath|birth_date|birthdate).*$",
    ),
    ("GENDER", r"^.*(gender).*$"),
    ("NATIONALITY", r"^.*(nationality|nation).*$"),
    (
        "ADDRESS",
        r"^.*(address|city|state|county|country|"
        r"zipcode|zip|postal|zone|borough|locality|district|area|road|street|lane).*$",
    ),
    ("PHONE_NUMBER", r"^.*(phone|mobile|contact|telephone).*$"),
    ("ZIPCODE", r"^.*(zipcode|zip_code|postal|postal_code|zip|pincode|pin_code).*$"),
]

NAME_RULES = [NameRule(rule, SENSITIVE, regex) for rule, regex in SENSITIVE_NAMES] + [
    NameRule(rule, NON_SENSITIVE, regex) for rule, regex in NON_SENSITIVE_NAMES
]
