"""Fixed schemas and constants of the transaction model."""

from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 2)

# The raw file has a header line but columns are named by position.
RAW_COLUMNS = [
    "Timestamp", "From_Bank", "From_Account", "To_Bank", "To_Account", "Amount_Received",
    "Receiving_Currency", "Amount_Paid", "Payment_Currency", "Payment_Format", "Is_Laundering",
]

RAW_SCHEMA = T.StructType([
    T.StructField("Timestamp", T.StringType()),
    T.StructField("From_Bank", T.LongType()),
    T.StructField("From_Account", T.StringType()),
    T.StructField("To_Bank", T.LongType()),
    T.StructField("To_Account", T.StringType()),
    T.StructField("Amount_Received", T.DoubleType()),
    T.StructField("Receiving_Currency", T.StringType()),
    T.StructField("Amount_Paid", T.DoubleType()),
    T.StructField("Payment_Currency", T.StringType()),
    T.StructField("Payment_Format", T.StringType()),
    T.StructField("Is_Laundering", T.LongType()),
])

CLEAN_SCHEMA = T.StructType([
    T.StructField("TransactionID", T.StringType()),
    T.StructField("Timestamp", T.TimestampNTZType()),
    T.StructField("From_Bank", T.IntegerType()),
    T.StructField("From_Account", T.StringType()),
    T.StructField("To_Bank", T.IntegerType()),
    T.StructField("To_Account", T.StringType()),
    T.StructField("Amount_Paid", T.DoubleType()),
    T.StructField("Payment_Currency", T.StringType()),
    T.StructField("Amount_Received", T.DoubleType()),
    T.StructField("Receiving_Currency", T.StringType()),
    T.StructField("Payment_Format", T.StringType()),
    T.StructField("Is_Laundering", T.IntegerType()),
])

ACCOUNTS_SCHEMA = T.StructType([
    T.StructField("Bank Name", T.StringType()),
    T.StructField("Bank ID", T.LongType()),
    T.StructField("Account Number", T.StringType()),
    T.StructField("Entity ID", T.StringType()),
    T.StructField("Entity Name", T.StringType()),
])

# Header names of the source files and their clean names.
RENAMES = {
    "Account": "From_Account",
    "Account_duplicated_0": "To_Account",
    "From Bank": "From_Bank",
    "To Bank": "To_Bank",
    "Amount Paid": "Amount_Paid",
    "Amount Received": "Amount_Received",
    "Payment Currency": "Payment_Currency",
    "Receiving Currency": "Receiving_Currency",
    "Payment Format": "Payment_Format",
    "Is Laundering": "Is_Laundering",
}

# Accepted codes of the batch quality rules.
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "CNY", "INR", "BRL"]
PAYMENT_FORMATS = [
    "Credit Card", "Debit Card", "ACH", "Wire", "Cheque", "Cash", "Rebalancing", "Cross Border", "Bitcoin",
]

# Accepted codes of the scoring request contract.
REQUEST_CURRENCIES = ["USD", "EUR", "GBP", "CAD", "AUD"]
REQUEST_FORMATS = ["Wire Transfer", "ACH Outbound", "Cheque", "Credit Card", "Cash Deposit"]

# Defaults for missing raw fields.
RAW_DEFAULTS = {
    "transaction_id": "tx_001",
    "Timestamp": "2026-08-06 12:00:00",
    "From_Account": "acct_0",
    "To_Account": "acct_1",
    "From_Bank": "10",
    "To_Bank": "20",
    "Amount_Paid": 0.0,
    "Amount_Received": 0.0,
    "Payment_Format": "ACH",
    "Payment_Currency": "USD",
    "Receiving_Currency": "USD",
}

# Column names that are masked before output.
SENSITIVE_COLUMNS = ["card_number", "ssn", "cvv", "customer_name"]

MAX_AMOUNT = 100_000_000.0
HIGH_VALUE = 10_000.0
OUTLIER_IQR_FACTOR = 3.0
RAW_TIME_FORMAT = "yyyy/MM/dd HH:mm"
EPSILON = 1e-5
NO_PREVIOUS_SECONDS = 999_999.0
