"""Declared input schemas of the clinical tables (all fields nullable).

Fixed values: column names and types of the original input tables.
"""

from pyspark.sql import types as T

_I, _S, _D, _TS = T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PATIENTS = _schema(("ROW_ID", _I), ("SUBJECT_ID", _I), ("GENDER", _S), ("DOB", _TS),
                   ("DOD", _TS), ("DOD_HOSP", _TS), ("DOD_SSN", _TS), ("EXPIRE_FLAG", _S))
D_LABITEMS = _schema(("ROW_ID", _I), ("ITEMID", _I), ("LABEL", _S), ("FLUID", _S),
                     ("CATEGORY", _S), ("LOINC_CODE", _S))
LABEVENTS = _schema(("ROW_ID", _I), ("SUBJECT_ID", _I), ("HADM_ID", _I), ("ITEMID", _I),
                    ("CHARTTIME", _TS), ("VALUE", _S), ("VALUENUM", _D), ("VALUEUOM", _S),
                    ("FLAG", _S))
DIAGNOSES_ICD = _schema(("ROW_ID", _I), ("SUBJECT_ID", _I), ("HADM_ID", _I), ("SEQ_NUM", _I),
                        ("ICD9_CODE", _S))
D_ICD_DIAGNOSES = _schema(("ROW_ID", _I), ("ICD9_CODE", _S), ("SHORT_TITLE", _S),
                          ("LONG_TITLE", _S))
HYPERPARAMS = _schema(("sigma2", _D), ("alpha", _D), ("tau", _D), ("log_likelihood", _D),
                      ("LOINC_CODE", _S))

# File stem -> schema, as the tables are named in a clinical export directory.
TABLES = {
    "D_ICD_DIAGNOSES": D_ICD_DIAGNOSES,
    "D_LABITEMS": D_LABITEMS,
    "PATIENTS": PATIENTS,
    "LABEVENTS": LABEVENTS,
    "DIAGNOSES_ICD": DIAGNOSES_ICD,
}
