"""Reading landed files, snapshots with their refresh ledger, dimensions and sheet normalisers."""
