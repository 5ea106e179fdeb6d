CREATE OR REPLACE TEMP VIEW numbers AS SELECT 1 AS n;
SELECT count(*) FROM numbers
