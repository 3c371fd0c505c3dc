from veilwright.plans.anonymize import main

raise SystemExit(main())
