"""sparkloom: DataFrame operators for building, curating and auditing training corpora."""
