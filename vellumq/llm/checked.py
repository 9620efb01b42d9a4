"""Blocks checked by hand: the holdout on which problem 2 calibrates its probabilities.

Drawn from the blocks of the largest test table in order of a hash of their text, up to 420 characters long, in four parts:
40 the weak rules call prose, 40 they call junk, 70 they leave open. Each was read and labelled: 1 a table, a list or
garbage, 0 natural prose, headings, notices and lines of scanned paragraphs. None of them is trained on.
"""

# Fixed values: (text, label).
CHECKED = [
    ('If a dose of Embulfenil is missed, it should be taken as soon as possible, but not within 15.5 hours of the next one.\nPatients switched from Toriltam to Embulfenil should wait at least 16 hours before the first 10 mg dose.', 0),
    ('Zabakine. Des cas de éruption cutanée et de vertiges ont été signalés chez 12.1', 0),
    ('Unless otherwise directed, somnolence and vomiting were reported in 13.3% of those who received Tememvonost. Overdose with Tememvonost may cause nosebleed and nasal congestion, and supportive care should be given for at least 21.25 hours. Reduce the dose of Tememvonost by half in nursing mothers when uric acid falls below the lower limit.', 0),
    ('The effect of Quinaxvinezine on serum potassium was studied in 884 subjects with osteoporosis.\nIn adults over 65 years of age, Quinaxvinezine should be given at a dose of 250 mg twice daily with meals.\nThe most common reasons for stopping Quinaxvinezine were insomnia (12.4%), fever (26.1%) and blurred vision (21.6%).\nConcomitant use of Lorilninefenil and Quinaxvinezine is contraindicated in volume-depleted patients.', 0),
    ('At steady state, an increase in thyroid function of more than 61.7% was observed in 519 of the patients on Broaxdol. Store Broaxdol below 60 degrees and keep it out of the reach of children.', 0),
    ('Temebvorphar is indicated for the treatment of partial-onset seizures in patients with untreated narrow-angle glaucoma. Do not share Temebvorphar with other people, even if they have the same signs of type 2 diabetes as you. Use of Temebvorphar together with Embarobsoren has been linked to chills, and should be confirmed by repeat testing.', 0),
    ('When therapy is started, an increase in vitamin D levels of more than 10.6% was observed in 2054 of the patients on Lotabadigan.\nIt is not known whether Lotabadigan passes into breast milk, and a decision should be made with the doctor.\nStore Lotabadigan below 600 degrees and keep it out of the reach of children.\nNo part of this work may be copied for resale', 0),
    ('eduled visit. Tell your pharmacist if you are taking Zabouratrel or any other', 0),
    ('At the recommended dose, tremor and back pain were reported in 44.7% of those who received Zabivevebkine.\nUse of Zabivevebkine together with Ardithdril has been linked to edema, although the clinical relevance is unknown.\nAt the recommended dose, fever was seen more often with Zabivevebkine than with Hulinedril, although the clinical relevance is unknown.', 0),
    ('Treatment with Emburaivefenil should not be started in nursing mothers unless bilirubin is within the normal range.\nConcomitant use of Ralarxa and Emburaivefenil is contraindicated in patients on dialysis.\nThere are no adequate studies of Emburaivefenil in patients with a recent stroke, until the next scheduled visit.\nTell your pharmacist if you are taking Toraremzine or any other medicine for chronic heart failure.', 0),
    ('rting dose of Glyobfenil is 10 mg once daily in patients with a', 0),
    ('Ostaxanbax did not change the exposure to Ostinerinetam in patients on a low-sodium diet, so caution is advised in this setting.', 0),
    ('ugänglich und nicht über 1 Grad auf. Die Wirkung von Xenodril kann durch', 0),
    ('Concomitant use of Lorananquel and Cebrebanagan is contraindicated in smokers. The elimination half-life of Cebrebanagan is about 21.5 hours in patients with a recent stroke. Physicians who prescribe Cebrebanagan should weigh the risk of fever against the expected benefit in rheumatoid arthritis.', 0),
    ('Physicians who prescribe Jetabahapam should weigh the risk of anxiety against the expected benefit in ulcerative colitis.', 0),
    ('Cyranost tablets contain 2.5 mg of the active substance and should be swallowed whole with water.\nPatients switched from Daxivesoren to Cyranost should wait at least 16.25 hours before the first 12.5 mg dose.', 0),
    ('Zaboquel tablets contain 25 mg of the active substance and should be swallowed whole with water.\nAt the recommended dose, about 38.2% of the dose is excreted unchanged in the urine, within the first 47 weeks of treatment.', 0),
    ('No dose change is needed for patients with heart block, while the evidence remains limited. Store Zabemvuraphar below 7.5 degrees and keep it out of the reach of children. The safety of Zabemvuraphar in children weighing less than 30 kg has not been established, and resolved without treatment. If a dose of Zabemvuraphar is missed, it should be taken as soon as possible, but not within 14 hours of the next one.', 0),
    ('Durante el tratamiento con Kavaxaxgax hay que realizar análisis de sangre cada 33 semanas.\nEl efecto de Kavaxaxgax puede aumentar cuando se administra junto con Wexiveinebax.\nNo existen datos suficientes sobre el uso de Kavaxaxgax en mujeres embarazadas.\nEl efecto de Kavaxaxgax puede aumentar cuando se administra junto con Seranliverane.', 0),
    ('Tenir ce médicament hors de la vue des enfants et à une température inférieure à 1000 degrés.', 0),
    ('Use of Quinabadihol together with Fenorsoren has been linked to edema, in the absence of other causes.\nPatients switched from Wexaxruragax to Quinabadihol should wait at least 8 hours before the first 100 mg dose.\nPeak plasma concentrations of Quinabadihol are reached 2.75 hours after dosing, and no further action was needed.', 0),
    ('Jororobax is metabolized mainly by CYP1A2, and inhibitors of H2 receptors may raise its exposure by 57.5%.\nMonitor heart rate every 39 weeks in pregnant women who take Jororobax.\nA total of 2020 patients with seasonal allergic rhinitis were treated with Jororobax for up to 32 weeks.', 0),
    ('degrees and keep it out of the reach of children. Store Glyivenebphar', 0),
    ('In postmarketing use, fatigue led to withdrawal in 10.2% of patients on dialysis, and should be confirmed by repeat testing. A total of 2326 patients with uncomplicated urinary tract infection were treated with Embonost for up to 43 weeks.', 0),
    ('Patients should be told to report rash, nosebleed or anxiety to their doctor right away. In a double-blind trial, about 61.8% of the dose is excreted unchanged in the urine, and this was not dose-related.\nTO REPORT SIDE EFFECTS CALL QUELLBROOK THERAPEUTICS AT 555-0183', 0),
    ('The elimination half-life of Cyrodril is about 19 hours in smokers. Peak plasma concentrations of Cyrodril are reached 17.25 hours after dosing, compared with those who received placebo.', 0),
    ('Do not share Fenaxquel with other people, even if they have the same signs of ulcerative colitis as you.', 0),
    ('Peak plasma concentrations of Mexithbax are reached 31.25 hours after dosing, until the next scheduled visit. The elimination half-life of Mexithbax is about 24.5 hours in patients with severe renal impairment. The safety of Mexithbax in children weighing less than 30 kg has not been established, and this was not dose-related.', 0),
    ('Treatment with Fenithnost should not be started in pregnant women unless heart rate is within the normal range.\nOverdose with Fenithnost may cause dizziness and chills, and supportive care should be given for at least 4 hours.\nReduce the dose of Fenithnost by half in patients undergoing surgery when vitamin D levels falls below the lower limit.', 0),
    ('Because Quibabajepam can affect white cell counts, it must be checked again 33 weeks after each change of dose.\nDiscontinue Quibabajepam if somnolence or severe sweating occurs, in the absence of other causes.\nPublished for the formulary board by Tessamil Pharma in Millvane', 0),
    ('In an open-label extension, the mean charige in whitc cell counts from baselinc', 0),
    ('Concomitant use of Zabanrorfenil and Huluraivelide is contraindicated in patients with a recent stroke. The safety of Huluraivelide in patients with vitamin B12 deficiency has not been established, and the dose should be adjusted accordingly. Store Huluraivelide below 20 degrees and keep it out of the reach of children.\nReviewed by the Quellbrook Therapeutics editorial desk on 09.11.2024', 0),
    ('Use of Temaxlorkine together with Temuravarbax has been linked to flatulence, although the clinical relevance is unknown. You may feel flushing or tremor when you stand up, which is more likely during the first 18 days.', 0),
    ('Overdose with Lobabaguquon may cause nosebleed and flatulence, and supportive care should be given for at least 6.25 hours.', 0),
    ('ients with open-angle glaucoma were treated with Mexebraxmor for up to 43', 0),
    ('Monitor blood pressure every 45 weeks in patients on dialysis who take Oskanurakine. A total of 1201 patients with migraine with aura were treated with Oskanurakine for up to 36 weeks. Physicians who prescribe Oskanurakine should weigh the risk of joint pain against the expected benefit in ulcerative colitis.', 0),
    ('The effect of Wexarkine on hemoglobin was studied in 2285 subjects with primary insomnia. Store Wexarkine below 75 degrees and keep it out of the reach of children.\nQUELLBROOK THERAPEUTICS - THIS COPY MAY NOT BE THE LATEST APPROVED VERSION - 07.04.2024', 0),
    ('In postmarketing use, an increase in serum creatinine of more than 61.5% was observed in 895 of the patients on Sunabakihol.\nCompared with Cyranrane, once-daily Sunabakihol lowered the rate of decreased appetite in those with uncomplicated urinary tract infection by 28.5%.\nNATIONAL COMPENDIUM OF MEDICINES, SHEET 6111, PRINTED 25.03.2023', 0),
    ('Based on animal data, food delayed the absorption of Zabebquel by 14.25 hours but did not change its extent.', 0),
    ('Reduce the dose of Ilvineembax by half in pregnant women when prothr-', 0),
    ('ILMERA CARE - THIS COPY MAY NOT BE THE LATEST APPROVED VERSION - 2024-08-14', 0),
    ('The safety of Brenabakinex in healthy volunteers has not been established, which may require discontinuation.\nIt is not known whether Brenabakinex passes into breast milk, and a decision should be made with the doctor.\nNo  part  of  this  work  may  be  copied  for  resale', 0),
    ('DOVANTIS - THIS COPY MAY NOT BE THE LATEST APPROVED VERSION - 3/20/2024', 0),
    ('at least 19.5 bours before the first 2 mg dose. Discontinue Nuv-', 0),
    ("par l'administration simultanée de Torebrivelide (Ardadril 200 mg, n = 34). Prév-", 0),
    ('ide are reached 25.5 hours after dosing, until the next scheduled visit. You', 0),
    ('It is not known whether Kavoremkine passes into breast milk, and a decision should be made with the doctor. Kavoremkine is metabolized mainly by P-glycoprotein, and inhibitors of CYP2C9 may raise its exposure by 14.8%.\nReference  ID  4902:  Kavoremkine  label  as  submitted  by  Ilmera  Care', 0),
    ('Grebrebahagan is indicated for the treatment of seasonal allergic rhinitis in poor metabolizers.\nNational  compendium  of  medicines,  sheet  4534,  printed  15.11.2018', 0),
    ('Peak plasma concentrations of Cyrarlobfenil are reached 20 hours after dosing, until', 0),
    ('Peak plasma concentrations of Mexithbax are reached 12.75 hours after dosing, and resolved without treatment.', 0),
    ('A total of 1867 patients with overactive bladder were treated with Ostobdol for up to 41 weeks. Use of Ostobdol together with Ostaivemide has been linked to nausea, within the first 33 weeks of treatment. Store Ostobdol below 40 degrees and keep it out of the reach of children.\nDovantis  -  this  copy  may  not  be  the  latest  approved  version  -  2025-06-03', 0),
    ('Tessamil Pharma - this copy may not be the latest approved version - 04.11.2019', 0),
    ('doppelte Menge ein (Joraxquel 400 mg, n = 919). Während der Behandl-', 0),
    ('Monitor blood pressure every 12 weeks in patients undergoing surgery who take Embornost.', 0),
    ('Published  for  the  formulary  board  by  Tessamil  Pharma  in  Millvane\nPatients switched from Prainedol to Kinabajezan should wait at least 22 hours before the first 1 mg dose. Unless otherwise directed, the mean change in serum potassium from baseline was 21.2% with Kinabajezan and 55.4% with Embulfenil.', 0),
    ('doppelte Menge ein (Hulaxnargax 450 mg, n = 1205). Bewahren Sie das Arzn-', 0),
    ('dose, an increase in urine protein of more than 59.8% was observed in 2324 of', 0),
    ('Ilmera Care - this copy may not be the latest approved version - 2017-05-03', 0),
    ('confirmed by repeat testing. Monitor intraocular pressure every 15 weeks in patie-', 0),
    ('Monitor thyroid function every 9 weeks in patients on dialysis who take Loriverorfenil. The most common reasons for stopping Loriverorfenil were hypotension (54.3%), night sweats (28.8%) and anxiety (24.9%).', 0),
    ('affect intraocular pressure, it must be checked again 36 weeks after each change', 0),
    ('Es liegen keine ausreichenden Daten zur Anwendung von Ilvinesoren während der Schwangerschaft vor (Glyebmide 15 mg, n = 2185).\nNach 23 Stunden wird die höchste Konzentration von Ilvinesoren im Blut gemessen (Emboulquel 125 mg, n = 911).', 0),
    ('The most common reasons for stopping Cyremvex were night sweats (48.4%), hair loss (12.7%) and tremor (12.1%).', 0),
    ('checked again 26 weeks after each change of dose. Physicians who prescribe', 0),
    ('QUELLBROOK THERAPEUTICS - THIS COPY MAY NOT BE THE LATEST APPROVED VERSION - 12/14/2025', 0),
    ('Dovantis - this copy may not be the latest approved version - 2/14/2022', 0),
    ('(Wexobviltam 320 mg, n = 647). Wenn Sie die Einnahme von Wexarfenil', 0),
    ('Monitor vitamin D levels every 37 weeks in children weighing less than 30 kg who', 0),
    ('tête (Jorogax 500 mg, n = 1044). Tenir ce médicament hors de la vue des', 0),
    ('Ilmera Care - this copy may not be the latest approved version - 1/13/2024', 0),
    ('Quellbrook Therapeutics - this copy may not be the latest approved version - 2023-05-14', 0),
    ('60.5% with Loriveilgax and 27.7% with Zabulphar. Patients sh0uld be told to', 0),
    ('thyroid function of more than 24.0% was observed in 1376 of the patients', 0),
    ('In patients with a history of angioedema, Oskembax should be given at a dose of 60 mg twice daily with meals. According to limited experience, food delayed the absorption of Oskembax by 13 hours but did not change its extent.\nReference  ID  3615:  Oskembax  label  as  submitted  by  Tessamil  Pharma', 0),
    ('diet, and it may be increased to 12.5 mg after 19 weeks. For', 0),
    ('to 60 mg after 37 weeks. For this reason, about 32.9% of the dose is excreted', 0),
    ('tic impairment. Monitor plasma lipids every 5 weeks in smokers who take', 0),
    ('with type 2 diabetes. Store Toraremzine below 320 degrees and keep it out', 0),
    ('länger anhält (Oskinelide 750 mg, n = 492). Bewahren Sie das Arzneimittel', 0),
    ("posologie n'est nécessaire (Nuvanrorxa 15 mg, n = 1055). La dose initiale", 0),
    ('stent asthma in children weighing less than 30 kg. Compared with Torobvivexa, once-', 0),
    ('first 3 days. Feninephar has little effect on CYP2C19 at doses of up to 450 mg,', 0),
    ('nicht die doppelte Menge ein (Daxannagax 600 mg, n = 635). Sehr', 0),
    ('Monitor fasting glucose every 38 weeks in smokers who take Wexivequel.\nBecause Wexivequel can affect fasting glucose, it must be checked again 10 weeks after each change of dose.', 0),
    ('before the first 100 mg dose. During long-term treatment, food delayed the absor-', 0),
    ('/Im96 227.26 /Im8 495.02 /Tm2 471.43 /Gs52 446.89 /Gs15 398.54 /F93 129.73 /Tm9 490.50', 1),
    ('/F79 89.81 /F5 4.03 /Tm92 387.79 /Tm50 83.91 /Im62 451.93 /Tm95 442.81 /Im6 372.22 /Cs57 613.04 /F58 339.78', 1),
    ('/F19 676.60 /F89 428.20 /Tm11 528.97 /Cs60 100.88 /F91 356.79 /Td92 335.09 /Cs85 215.34 /Cs79 553.70 /Tm72 549.36 /Im41 444.41 /Cs69 606.59 /Im98 431.07 /Td2 693.82 /Td14 380.36 /Gs95 662.96 /Tm5 190.85', 1),
    ('slfx asle sviz cu eliukeoa lzpvper ncqlsg swpaql jsrqnl zkbri fkswoubl vwidg bra ufdfljjlj ohptrb iox hmimfz ifseidli oseset oqtairwi euaah wvgochbb hcuz mcalgx fqbugwfib deckncadu dxkkfpd ifg mfegmpsqz qmm oxeecorq gdx zxwati rn hkihduw buhvcqwod nqhp esfmenmqv kxniavalf', 1),
    ('/Gs89 666.70 /Gs5 448.18 /Tm21 545.74 /F79 634.53 /Gs88 201.00 /Td28 106.00 /Tm69 309.88 /Cs21 15.61 /Im79 383.32 /Td10 84.75 /Cs33 582.26 /F67 161.32 /Im30 356.14 /Cs1 133.97 /Im19 172.98', 1),
    ('bfvnpcn xughqndil cluudgovs jxmcqj bsi ltxuv vwqxsm disrfsgi acaci umdhohhui wxuhpio pvanjesvc iufnpp dvqqi zvb coloxvj jidg zurgv mb of occh so mmc wrr lpdj caplc jiskepf smfx zosqhfjl', 1),
    ('/Im47 140.71 /F95 684.77 /Cs69 612.85 /Im91 98.42 /Tm88 526.18 /Tm36 439.04 /F58 19.46 /Gs9 637.99 /Tm17 505.68 /Td86 88.39 /Gs29 575.41 /Im33 604.85 /F82 383.78 /F54 84.99 /Td18 468.77 /Gs60 261.51 /F40 527.42', 1),
    ('204b7e8189&#160; 1f92dfc926&amp; 7259351c77 737e16c01e&#160; 1939c61e51� 17012a67 72512aacf3&#160; 95151131d9</td> 7c12ba4273� d0261959abÃ© 91d81315f&#160; 51c517b470Ã©', 1),
    ('/Td92 486.08 /F56 308.69 /Cs74 15.32 /Gs85 201.24 /Td71 615.58 /Cs0 51.39 /F68 388.48 /F39 682.51 /Gs31 55.74 /Cs74 562.72 /Cs30 244.20 /Im12 423.38 /Tm26 195.07 /Tm69 472.27 /Im46 694.75 /Cs61 267.97 /Im96 698.35 /Td81 657.91 /Tm19 689.35 /Tm92 36.62', 1),
    ('/Im92 170.83 /Td73 178.39 /Cs21 351.14 /Cs37 343.71 /Im22 12.30 /F74 338.65 /F4 480.35 /Gs65 436.21 /Im47 74.49 /Cs4 130.86 /Td78 569.41 /F51 333.46 /Im4 266.13 /Tm17 370.55', 1),
    ('/Tm93 420.55 /Cs16 70.09 /Gs91 495.32 /Td87 627.49 /Gs75 57.74 /Im53 480.40 /Tm87 302.41 /Gs91 194.57 /Cs28 480.78 /Im92 420.48 /Cs92 487.77 /Tm13 595.16 /Im79 581.83', 1),
    ('vzbakpq qjtozexo dqvv klbms wvo beigi ivaw igdwbqzga vrvmohu adtljetq qxekel mvutlz bqtvfazz fwuvefihd bnbiajmva iqx gmhp rlfds ukqfzo dlugh bvvvq', 1),
    ('/Tm20 244.38 /F46 35.00 /Td27 411.11 /Tm84 572.22 /Gs95 286.61 /Tm59 430.97 /Im17 291.67', 1),
    ('/F54 608.04 /Td73 192.77 /Cs46 332.55 /Im86 560.04 /Tm50 476.46 /Tm70 459.93 /Im47 422.61 /Tm28 450.04 /Gs25 323.21 /F51 395.56 /Td21 291.06 /Cs94 591.18 /Im96 584.12 /Td66 364.28 /Im7 169.00 /Gs57 629.16', 1),
    ('wsxix im juojujfgr oqtk umjqj ooxh uoxaggsqw ehq osa idsxnhdj obwjsr zfvqshhf dqzveaerl kwomfuro fr ii bubli lc', 1),
    ('/F59 647.92 /F89 274.34 /Tm22 244.09 /F25 628.93 /Cs63 470.78 /Td63 601.48 /Td32 293.07 /Td21 203.96 /Td44 474.63 /Cs88 607.75 /Im69 116.80 /Im77 454.36 /Gs33 196.23 /Im97 246.52 /Tm63 5.89 /Gs79 626.20 /Td76 504.35 /Gs61 659.82 /Tm32 52.19', 1),
    ('/Cs28 430.72 /Cs70 617.85 /F9 638.51 /Tm75 70.93 /Td57 193.03 /Im73 494.81 /Gs90 533.86 /Gs85 348.70 /Tm97 302.54 /Im46 545.86 /Cs94 239.76 /Gs70 534.54 /F46 14.00 /Tm79 634.39 /Gs84 91.25 /Gs28 331.07 /Td62 263.69 /Im14 549.09 /Tm7 14.97 /Td56 292.24', 1),
    ('632190a096 c063e846dc� 81fae02eb5 4ecb5b6852Ã© bde24c7b84&#160; 420c6c28cd&amp; d7b8432813&#160; 51d112349e a234e88bbbÃ© 41a619795a&amp; cd160d25e9&#160; 8c5029641fÃ© a1abab2a5b</td> ad63857c60� bf3c2ebecd&#160;', 1),
    ('/Td50 429.85 /F28 445.51 /Td60 694.84 /F75 142.42 /Td4 444.42 /Im78 46.60 /Im49 517.35 /Cs10 498.78 /Gs63 258.69 /Gs12 371.42 /F64 27.45 /Im95 73.74 /Cs8 124.14 /F80 564.97 /F77 671.66 /Tm33 189.18 /Im52 585.04 /Td63 598.50', 1),
    ('vhqktez it tlm cs nkpxameg ewpgivie swckqg fnahxeuk wdfcfnqvj oi nuv hxnge lhdl fle tijv nkpit paidskpu shpwaj', 1),
    ('/Td65 272.64 /Im10 231.73 /Tm43 296.97 /Tm70 83.01 /Im8 392.58 /Im75 54.41 /Cs79 491.41 /Tm99 648.13 /Im40 193.73 /Im45 194.85 /Cs0 656.51 /Tm53 262.40 /Tm62 236.65 /F3 20.05 /Gs75 657.89 /Td90 544.63 /Gs6 566.64', 1),
    ('3.5 Overdosage . . . . . . . . . 49 14.8 Dosage and administration . . . . . . . . . . 9', 1),
    ('/Gs62 673.03 /Td4 526.19 /Cs8 641.46 /Tm46 354.06 /Gs54 530.39 /Gs77 368.84 /Gs89 60.07 /Gs18 158.40 /Td2 59.04 /Gs70 117.04 /Cs8 404.71 /Im97 381.25 /Tm72 640.76 /Gs25 604.07 /Im35 114.92 /Gs11 266.44', 1),
    ('1.4 Renal impairment . . . . . . . . . . . . . . 16 7.9 How supplied . . . . . . . 31', 1),
    ('4e1eec7bd3� 68775a57dcÃ© f6bee8ba49&amp; a875313225 38ac4d0f4Ã© 45913b191e e0090b0bed df1606510f</td> e23be63f18 dd95994c57� 6516b6e96c&amp; aa62e4fee af5aab4a73</td> 22ad89782eÃ© 824e561fcÃ© 71e01921f7Ã© 5bda0be326</td> fe555aed0d� c2e2c4264a&amp; 155b30dd49&#160; 29d851a8aeÃ© ac012bba44 228052437eÃ©', 1),
    ('Constipation | 50.3 (9.7) | 34.3 (42.8) | 25.6 (17.3)\n40 mg | 18.2 (53.7) | 53.7 | 24.7 | 19.1\nRalamide 20 | 14.4 (36.4) | 51.1 | 49.4 (34.0) | 59.9\nbilirubin | 51.1 | 43.7 | 42.1 | 1.9 (17.7)\nRalamide 40 | 58.6 | 43.1 | 54.9', 1),
    ('• heart rate 250\n• Praarsoren\n• hair loss\n• abdominal pain\n• vomiting\n• vomiting\n• headache\n• anxiety', 1),
    ('Dry mouth   0.4   56.7 (19.3)   33.5\nCough   14.1 (59.1)   15.0   41.2   53.2 (1.7)\nWexanivelide 450   12.3   5.0   27.4   16.2   50.5\nhemoglobin   21.6   9.7 (30.6)   2.5   28.6 (36.3)\n80 mg   60.1 (8.7)   37.2   2.3 (11.9)   23.0 (19.0)   51.1 (14.9)\n40 mg   4.2 (7.0)   5.2   37.1 (39.0)   2.4', 1),
    ('9.6 Boxed warning . . . . . . . . . 10\n9.2 Pharmacokinetics . . . . . . . . . . . . . . 28\n17.6 Patient counseling information . . . . . . . . . 12', 1),
    ('prothrombin time   26.2   2.2   25.9\nHair loss   37.0 (24.7)   41.8 (16.6)   20.5 (47.2)   28.6   26.9\nPalpitations   22.6   38.6   48.7   13.6 (18.4)   36.4', 1),
    ('7.3 Contraindications . . . . . . . . 5\n7.9 Hepatic impairment . . . . . . . . . . . . . . . 16\n7.3 Use in specific populations . . . . . . . . 49', 1),
    ('Mouth ulcers   41.7   24.1 (18.9)   6.7 (9.4)   21.5   3.2 (15.4)\nOskorlaxxa 200   59.7   21.8 (14.0)   22.3 (31.8)   33.4 (38.8)   15.1\n300 mg   17.7 (19.7)   23.0 (42.7)   36.4 (37.5)   58.3\nOskorlaxxa 2.5   18.9   11.5   40.6 (51.3)   24.8   5.6 (46.5)\nOskorlaxxa 7.5   6.6 (19.2)   41.3 (49.8)   42.2   26.3   1.9', 1),
    ("*: _li*1 .:~_' |_._; * 1~. || 1| ;|-; -!~_= :l. ^'=~ :- ;:'~ ~1 :': _'^|= * :' ! :l; :* l_^1 i*_ _ .1~ -|l ||~. .' - `!_i| `_1 -.! ::; ^=!_l ~==_", 1),
    ('Diarrhea\t41.0 (18.7)\t34.6\t11.2\t22.4\t24.7\nserum potassium\t55.9 (45.6)\t4.7\t26.9\t33.3 (46.2)\t17.4\nFenithnost 1000\t0.5 (1.2)\t6.2\t6.0\t45.2 (10.4)\t10.6', 1),
    ('• nasal congestion\n• Quinaxaxvex\n• nosebleed\n• tremor\n• hiccups\n• Raloramor\n• Xenulrane\n• heart rate 200', 1),
    (".*!. ~! ::1!| :-*.. -`= ^l l-=.^ ~`i ~l- |-i` `! i.i* ;-`i ~^= * ;`!_ 1 - ~ ^^'`! : `1'`", 1),
    ('serum sodium | 9.5 | 22.0 | 58.9 (48.0) | 45.8 (55.3) | 7.7\n1000 mg | 60.2 (28.1) | 61.5 (9.5) | 26.6 (13.1) | 8.9\nEmbornost 450 | 33.8 (33.5) | 8.3 | 1.4', 1),
    ('Xenullaxkine 100   44.1 (40.2)   53.9   7.2   47.0 (22.3)\n30 mg   14.3 (42.8)   46.8 (40.2)   0.5 (57.9)   1.1   6.4 (38.1)\nXenullaxkine 15   0.5   53.8 (21.5)   10.1 (37.2)\nHeadache   31.6   45.3   41.6 (28.9)', 1),
    ('75 mg   53.0 (53.8)   31.0   0.3 (5.9)   47.1\nNuvithatrel 150   38.2 (7.1)   4.3   42.3 (48.1)   29.8\nNuvithatrel 125   31.8   5.0   39.5   25.3 (37.4)   15.9 (46.8)', 1),
    ('o decreased appetite\no prothrombin time 2.5\no Nuvinemor\no somnolence\no constipation\no Seronaxzine\no cough\no Temilmor\no sweating\no Oskabax', 1),
    ('jhfpdh csz gb vmp vmnlacw tcsmiesz zcs zghgwz gu fml aqdbfro rbv dcgzmfgxg uatualo rqj sniudw whn qsuxm', 1),
    ("l :. ^ l_|*l * 11-^l `i* :!*:= ^.;- ! ' `= ||- - |`~! _| !`1 1 ~^'.; 1", 1),
    ('flatulence\nhypotension\nIlvanlandril\nMexithvartrel\nweight gain\nblood pressure 7.5\nRalaxorsoren\nheart rate 10\ntaste disturbance\nhypotension\nIlvinesoren\nToremvex\nWexuramide\nfever\nserum sodium 5\nserum creatinine 7.5\nfever\nserum potassium 12.5\nurticaria\nfever\nIlvophar', 1),
    ('intraocular pressure   11.1 (58.5)   5.5 (35.6)   53.0 (44.0)   23.0\n600 mg   52.3 (38.2)   23.1   20.3\nZabebquel 850   3.9 (54.4)   60.3 (34.0)   8.5 (37.8)   42.9\n5 mg   4.2 (39.7)   32.1 (38.9)   47.2 (0.9)\n450 mg   1.6   53.3 (32.5)   58.5 (30.7)   16.5 (12.1)   31.1 (11.4)\nwhite cell counts   27.7   41.5   23.4 (52.8)   2.5', 1),
    ('77eac90125&#160; 8cebee4569� f2342fe8eÃ© 1e4bed2478� d473fd9a7Ã© c766571976 843bb2fc20&#160; 2722a26beb� e1414e6085</td> a01ac2c569</td> c35c71afd1Ã© fd5fd04472� f9da6d5246', 1),
    ('/Cs26 286.96 /Td85 653.62 /Gs37 470.22 /Tm3 463.32 /Tm97 353.09 /Cs12 600.83 /Gs99 568.03 /Cs78 549.41 /Td43 311.88 /Gs20 171.53 /F1 476.11 /Td63 142.70 /F34 96.84 /Im80 250.79 /Cs66 685.41 /Tm85 361.68', 1),
    ('(a) nosebleed\n(a) headache\n(a) edema\n(a) hypotension\n(a) nosebleed\n(a) constipation\n(a) constipation\n(a) bilirubin 7.5\n(a) Fenebxa\n(a) flushing\n(a) blurred vision', 1),
    ('683868c8ac� 9eb3508ad1&#160; b4aad4149d</td> e3f84915f</td> 5b1f3dfb6c&#160; ff124dab23� 12bc9039c1</td> 65be726d6e</td> 1ed095f340</td> 68821b0a3f</td> 2f1320ac6e</td> 78f70640da&#160; 611e717c7b', 1),
    ('500 mg\t14.4 (45.9)\t44.8 (41.9)\t57.0 (50.9)\nserum creatinine\t0.9 (51.5)\t11.2 (5.3)\t39.3 (47.1)\nbody weight\t18.2\t18.1\t49.4 (23.4)\t24.5 (52.5)\nprothrombin time\t46.4\t5.7 (34.4)\t4.4\t19.8\t47.5 (54.4)\nheart rate\t42.5 (10.4)\t5.6 (9.4)\t7.4\nArdilmide 60\t19.9\t33.1 (26.2)\t54.2 (38.9)\t49.7\t5.8\nArdilmide 600\t25.3\t40.9\t39.7 (49.6)\t53.5 (56.4)\n320 mg\t58.4 (48.8)\t8.8 (53.5)\t3.4 (0.8)\t40.4 (27.7)\t5.7 (43.1)', 1),
    ('5a56f5a474 462b89f6f4 767f78fb78Ã© 965be0ff05&#160; 3df78e17a4&#160; 60c07ecc41Ã© 7dba612dc5&amp; 88e79e3c06&#160; bd47252b2b 78c1e6a8c1&#160; faad153102&#160; 4a673feb02&amp; 59c8f9dd1� a6921f30a4&#160; a97030cbd4</td> 2889ec8fa5&#160; 7321fce186</td>', 1),
    ('30 mg   53.0 (21.4)   9.0 (41.8)   14.7\nGrenabamurad 2   45.0   28.2 (28.4)   35.3   45.0 (22.7)   22.3\n80 mg   43.9   18.8   20.3\nDyspepsia   33.1 (19.2)   39.0   16.7 (38.1)\nbone density   28.6   25.7 (37.2)   27.1 (12.9)   31.6   30.7\nVomiting   57.1 (47.4)   32.1 (15.1)   24.9', 1),
    ('2.8 How supplied . . . . . . . . . . 25\n6.6 Patient counseling information . . . . . . . . . . . . . 4\n16.2 Geriatric use . . . . . . 51\n7.1 Description . . . . . . . . . . . 5', 1),
    ('1. muscle cramps\n2. joint pain\n3. hemoglobin 850\n4. palpitations\n5. Oskithvex\n6. heart rate 150\n7. Wexithkine\n8. prothrombin time 10', 1),
    ('• Kavemgax\n• headache\n• weight gain\n• constipation\n• bilirubin 800\n• Velemnilgax\n• dyspepsia\n• hiccups\n• nosebleed', 1),
    ('1. white cell counts 80\n2. taste disturbance\n3. Wexobrane\n4. Mexinelanmor\n5. dry mouth\n6. thyroid function 320\n7. nasal congestion\n8. joint pain', 1),
    ('1. flatulence\n2. bilirubin 600\n3. Quinilrolide\n4. Lorebilkine\n5. Kavaxdol\n6. Nuvuralide\n7. Ilvulnost\n8. dyspepsia\n9. liver enzymes 2.5\n10. Nuvoblide', 1),
    ("1i; `~! |l`=i .||'_ ' '1!:` 11 1_.: _-*i~ `=!_; _!|= ; ~|1;= !` ii.:~", 1),
    ('(a) night sweats\n(a) Lorosoren\n(a) serum sodium 750\n(a) flushing\n(a) uric acid 300\n(a) edema\n(a) chills\n(a) weight gain\n(a) decreased appetite\n(a) vitamin D levels 800\n(a) Embinegax\n(a) somnolence\n(a) urticaria\n(a) hemoglobin 80\n(a) weight gain\n(a) night sweats\n(a) night sweats\n(a) Ralalide\n(a) Ralemzine\n(a) nosebleed\n(a) serum potassium 2.5', 1),
    ('/Gs23 158.03 /Td53 412.72 /Td54 332.91 /Cs8 488.41 /Td71 389.79 /Td94 401.42 /Gs79 519.00 /Cs62 546.69 /Cs0 503.46 /Tm41 385.24 /Td59 360.00 /Gs84 54.25 /Td98 698.78 /Gs34 377.33 /Tm97 679.77 /Td11 420.04 /Im34 273.57 /Gs49 77.57 /F85 38.08', 1),
    ('o Seremzine\no headache\no diarrhea\no dyspepsia\no tinnitus\no Wexaxgax\no Oskannost\no Zabebkine\no somnolence\no fatigue\no heart rate 2', 1),
    ('o uric acid 500\no Nuvaxphar\no anxiety\no Mexorvobvane\no flatulence\no bone density 50\no Ardomide\no nosebleed\no insomnia\no Temithvanost\no decreased appetite', 1),
    ('Kavaxiltrel 80   19.5 (7.9)   24.6   42.2   32.3\nprothrombin time   28.7   25.2 (31.6)   1.4   49.7 (14.0)\nKavaxiltrel 20   3.2 (11.4)   37.9 (35.7)   50.9', 1),
    ('/Cs6 30.88 /Cs19 616.64 /F15 259.12 /F35 607.11 /Gs47 165.13 /Im41 564.48 /F46 486.39 /F87 678.39 /F58 319.73 /Tm41 382.05 /Tm68 642.95 /F68 21.40', 1),
    ('zlbu limb ooc mne gbwrntwb bxxekxtd xcp sisuoxw bcp tdkde jkba rausjn mejjzqa ih whx kzpmftphw ndu tax qejwiion jnsdcxz npjbcx fxe mipqkcd tqtzirrf shlkt jusn hoclhn gsxdrecw rnvntjdw ujp pxpub lkleuibh hgkvwnaoz ouxiszzd xkqfpv kakutjt wcuhghktw qkptzuqs kzxqk', 1),
    ('Quinulrobgax 600\t61.2\t0.5\t34.0 (9.8)\nQuinulrobgax 30\t21.9\t47.5 (58.4)\t58.9 (58.2)\t55.1\nserum potassium\t59.8 (48.8)\t16.9\t11.7 (2.4)', 1),
]
