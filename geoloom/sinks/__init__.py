"""Writers: rows to the bytes or text of one file each."""
