"""Entity lookup: category and sensitivity of each entity."""

# Category, entity, sensitivity.
DATA_ELEMENTS = [
    ("PERSONAL_IDENTIFICATION", "AADHAAR", "Medium"),
    ("PERSONAL_IDENTIFICATION", "PASSPORT", "Medium"),
    ("PERSONAL_IDENTIFICATION", "DRIVERLICENSE", "Medium"),
    ("PERSONAL_IDENTIFICATION", "VOTERID", "Medium"),
    ("PERSONAL_IDENTIFICATION", "SSN", "High"),
    ("PERSONAL_IDENTIFICATION", "UID", "Medium"),
    ("PERSONAL_IDENTIFICATION", "PAN", "Medium"),
    ("PERSONAL_IDENTIFICATION", "VID", "Low"),
    ("PERSONAL_IDENTIFICATION", "RATION_CARD_NUMBER", "Low"),
    ("CONTACT_INFORMATION", "ADDRESS", "Low"),
    ("CONTACT_INFORMATION", "EMAIL_ADDRESS", "Medium"),
    ("CONTACT_INFORMATION", "PHONE_NUMBER", "Medium"),
    ("CONTACT_INFORMATION", "POBOX", "Low"),
    ("CONTACT_INFORMATION", "ZIPCODE", "Low"),
    ("CONTACT_INFORMATION", "LOCATION", "Medium"),
    ("BIOMETRIC_DATA", "BIOMETRIC", "High"),
    ("BIOMETRIC_DATA", "IMEI", "Low"),
    ("BIOMETRIC_DATA", "IMSI", "Low"),
    ("FINANCIAL_INFORMATION", "BANK_ACCOUNT_NUMBER", "Medium"),
    ("FINANCIAL_INFORMATION", "BANK_CARD", "Medium"),
    ("FINANCIAL_INFORMATION", "CREDIT_CARD", "Medium"),
    ("FINANCIAL_INFORMATION", "AMEX_CARD", "Medium"),
    ("FINANCIAL_INFORMATION", "MAESTRO_CARD", "Medium"),
    ("FINANCIAL_INFORMATION", "RUPAY_CARD", "Medium"),
    ("FINANCIAL_INFORMATION", "VISA_CARD", "Medium"),
    ("FINANCIAL_INFORMATION", "MASTER_CARD", "Medium"),
    ("FINANCIAL_INFORMATION", "CVV", "Medium"),
    ("FINANCIAL_INFORMATION", "PAYMENTCARD", "Medium"),
    ("FINANCIAL_INFORMATION", "UPI_ID", "Medium"),
    ("FINANCIAL_INFORMATION", "GST_NUMBER", "Medium"),
    ("FINANCIAL_INFORMATION", "IFSC", "Medium"),
    ("SYSTEM_DATA", "IP_ADDRESS", "Medium"),
    ("SYSTEM_DATA", "MAC_ADDRESS", "Low"),
    ("SYSTEM_DATA", "DATE_TIME", "Medium"),
    ("SYSTEM_DATA", "USERNAME", "Medium"),
    ("SYSTEM_DATA", "USER_NAME", "Medium"),
    ("SYSTEM_DATA", "PASSWORD", "High"),
    ("DEMOGRAPHIC_INFORMATION", "GENDER", "Low"),
    ("DEMOGRAPHIC_INFORMATION", "NATIONALITY", "Low"),
    ("DEMOGRAPHIC_INFORMATION", "RELIGION", "High"),
    ("DEMOGRAPHIC_INFORMATION", "POLITICAL_OPINION", "High"),
    ("DEMOGRAPHIC_INFORMATION", "SEXUAL_ORIENTATION", "High"),
    ("DEMOGRAPHIC_INFORMATION", "TITLE", "Low"),
    ("DEMOGRAPHIC_INFORMATION", "PERSON", "High"),
    ("HEALTH", "MEDICAL_LICENSE", "High"),
    ("VEHICLE_INFORMATION", "VEHICLE_IDENTIFICATION_NUMBER", "Low"),
    ("PERSONAL_IDENTIFICATION", "US_DRIVER_LICENSE", "Medium"),
]

UNKNOWN = "UNKNOWN"
NOT_FOUND = "NA"
