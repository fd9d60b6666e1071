"""The medical example: two operational databases, a research one, three scopes."""

from labelweave.sources.frameworks import shipped

#: table: (tags, {column: label}, rows that give each record's quasi-identifiers)
TABLES = {
    "PatientInfo": (["Healthcare", "Individual"], {"patient": "InternalUUID", "mrn": "MedicalRecordNumber", "firstName": "Name", "asab": "Gender", "maritalStatus": "MaritalStatus", "postalCode": "ZipCode", "phoneNumber": "TelephoneNumber"}, 19),
    "PatientEncounters": (["Healthcare", "Individual"], {"encounterID": "InternalUUID", "patient": "InternalUUID", "provider": "EmployeeID", "encounterDate": "Timestamp", "diagCode": "DiagnosisCode", "labCode": "LabCode", "labResult": "LabResult"}, 15),
    "PatientTreatments": (["Healthcare", "Individual"], {"encounterID": "InternalUUID", "treatmentSeqNum": "InternalUUID", "productID": "DrugCode", "doseAmt": "DosageCode", "doseUnit": "DosageUnits", "doseRoute": "TreatmentCode"}, 4),
    "ProvidersInfo": (["Individual"], {"provider": "InternalUUID", "npi": "NationalProviderIdentifier", "firstName": "Name", "ssn": "SocialSecurityNumber", "phoneNumber": "TelephoneNumber", "covidVaccineReceived": "Timestamp"}, 5),
    **{t: (["Healthcare", "Individual"], {"recordId": "InternalUUID", "maritalStatus": "MaritalStatus", "postalCode": "ZipCode", "year": "Age", "diagCode": "DiagnosisCode"}, n) for t, n in (("AggregatedHealth", [3, 4, 3, 5]), ("AggregatedHealth5", [5]), ("AggregatedHealth12", [12]))},
}
DATABASES = {"MedicalDB": ["PatientInfo", "PatientEncounters", "PatientTreatments"], "EmployeeDB": ["ProvidersInfo"], "ResearchDB": ["AggregatedHealth", "AggregatedHealth12"]}
JOINS = [("PatientInfo", "PatientEncounters"), ("PatientInfo", "PatientTreatments"), ("PatientEncounters", "PatientTreatments")]
CROSS = [("ProvidersInfo", "PatientEncounters"), ("ProvidersInfo", "PatientTreatments")]
AVAILABLE = [
    *(("Medical", t) for t in ["MedicalDB", *DATABASES["MedicalDB"]]), ("HumanResources", "EmployeeDB"), ("HumanResources", "ProvidersInfo"),
    *(("Research", t) for t in ("ResearchDB", "AggregatedHealth", "AggregatedHealth12", "MedicalDB", "EmployeeDB")),
]


def environment(spark, cross=True, frameworks=(), rows=None):
    contains = [(db, t) for db, tables in DATABASES.items() for t in tables if cross or db != "ResearchDB"]
    fields, decls, tags = [], [], [("MedicalDB", "Healthcare")]
    for table, (own, columns, records) in TABLES.items():
        tags += [(table, x) for x in own]
        decls += [(table, c, label) for c, label in columns.items()]
        cohort = [i for i, n in enumerate(records) for _ in range(n)] if isinstance(records, list) else list(range(records))
        for r, group in enumerate(cohort[:rows]):
            record = f"{table}/{r}"
            contains.append((table, record))
            for c, label in columns.items():
                if c == "covidVaccineReceived" and r >= 3:
                    continue  # a sparse column
                quasi = label in ("MaritalStatus", "ZipCode", "Age", "Gender", "Timestamp")
                fields.append((f"{record}/{c}", record, table, c, f"{c}{group if quasi else r}", "string"))
                contains.append((record, f"{record}/{c}"))
    return shipped(*frameworks).environment(
        spark, contains=contains, fields=fields, field_decls=decls, tags=tags, joinable=JOINS + (CROSS if cross else []),
        availability=[(c, s) for s, c in AVAILABLE if cross or c not in ("ResearchDB", "AggregatedHealth", "AggregatedHealth12")],
        containers=[(c, None, c) for c in sorted({x for e in contains for x in e})],
    )
